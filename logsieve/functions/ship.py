"""Make the library usable inside Python tasks without installing it on the executors: its functions,
classes and modules are pickled by value with the task."""

from __future__ import annotations


def ship_by_value(*module_names: str) -> None:
    """Call it before a task is made.  Registering the package covers all of its modules, also those that a
    shipped function reaches through others; further modules (of a caller's own scorer) can be named."""
    import sys

    from pyspark import cloudpickle
    for name in (__name__.partition(".")[0], *module_names):
        module = sys.modules.get(name)
        if module is not None and not name.startswith("__main__"):
            cloudpickle.register_pickle_by_value(module)
