"""Training-data operators.  Nothing else in quorumlens imports this subpackage."""
