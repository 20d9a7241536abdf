"""Reading and writing blobs, manifests and tables."""
