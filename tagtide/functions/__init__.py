"""Column-level functions: tag vocabulary, subword pieces, span segmentation."""
