"""Operators on pixels, detections, pairs, edges and tracklets."""
