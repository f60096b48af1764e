"""All registered queries."""

from importlib import import_module
from pkgutil import iter_modules


def load():
    for m in sorted(x.name for x in iter_modules(__path__) if x.name.startswith("q_")):
        import_module(f"{__name__}.{m}")
    from .registry import QUERIES, oracles

    return QUERIES, oracles()
