"""Training-data operators: one module per operator, queries registered in ``queries``."""
