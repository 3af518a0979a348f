"""Training-data operators: one module per operator, registry in ``queries``."""
