"""Row and table operators: parsing, contracts, disorder, manifests, data tests."""
