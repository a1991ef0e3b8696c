"""Training-data operators: scoring, scanning, fixity, decontamination, encoding,
near-duplicate joins and source mixing.  Nothing outside this package imports it."""
