"""DataFrame-to-DataFrame panel operators."""
