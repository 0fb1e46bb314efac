"""Name an intermediate value inside one expression."""

from pyspark.sql import Column, functions as F


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``: the finish of an empty fold, which copies nothing."""
    return F.aggregate(F.array(), value, lambda v, _: v, use)


def apart(c: Column) -> Column:
    """The column unchanged, through a lambda.

    A projection that holds one is compiled as many small methods; merged with its neighbours into one loop,
    hundreds of rules make a method too long for the JVM to compile.
    """
    return bind(c, lambda v: v)
