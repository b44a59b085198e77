"""Files and encodings."""
