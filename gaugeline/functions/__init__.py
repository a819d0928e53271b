from . import labels, predicates, scalars

__all__ = ["labels", "predicates", "scalars"]
