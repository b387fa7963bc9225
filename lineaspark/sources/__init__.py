"""Reading and writing of pixel, tracklet and graph tables."""
