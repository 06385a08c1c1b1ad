"""glyphmill: text-feature analytics and data preparation as Spark plans."""
