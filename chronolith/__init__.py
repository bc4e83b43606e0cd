"""Chronolith: search, passages and segmentation over many timelines of text, sound and pictures, on Spark."""
