"""Readers, writers, seed dimensions and the page extraction job."""
