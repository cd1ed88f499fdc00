"""Detection, span algebra, anonymisation, restoration and evaluation."""
