"""Operators for training data: filters, near copies, packing, scans, decontamination, fingerprints and scores."""
