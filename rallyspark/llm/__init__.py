"""Training-data operators: ten corpus operators that share only the helpers in ``common``."""
