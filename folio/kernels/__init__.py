"""Grammars that are sequential by nature: plain Python over one source at a time, no Spark import."""
