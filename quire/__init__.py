"""Aligned-text engine on Spark: segmentation, planning, integrity, alignment, context, state and merge."""
