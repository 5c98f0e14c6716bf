"""Training-data operators: one module for each, all registered in ``registry``."""
