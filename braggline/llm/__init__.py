"""Training-data operators: one module per operator, one thin query per operator in ``queries``.

Nothing else in the library imports this subpackage.
"""
