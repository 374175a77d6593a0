"""Containers whose pictures other codecs hold: boxes, HEIF, AVIF and WebP."""
