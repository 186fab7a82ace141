"""Operations of a training-data pipeline: formatting, fingerprints, filters, mixing, scans and classifiers."""
