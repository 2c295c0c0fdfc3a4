"""Training-data operators: one module per operator, registered by ``queries``.

Nothing else in the library imports this package.
"""
