"""quorumlens: competitive-metrics analytics expressed as Spark plans."""
