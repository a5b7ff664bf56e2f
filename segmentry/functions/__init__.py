"""Part of segmentry."""
