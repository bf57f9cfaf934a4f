"""Training-data operators: ten pipeline components, each in a module of its own.

Nothing else in the library imports this subpackage; its queries are in ``queries``.
"""
