"""Errors of the graph engine."""


class GraphError(Exception):
    """Base of all of them but UnreachableNode."""


class MarshallingError(GraphError):
    """A value that can't be put on the wire."""


class UnmarshallingError(GraphError):
    """Bytes from the wire that are no message."""


class DataError(GraphError):
    """A mutation failed, or the graph is closed."""


class DataPreparationFailed(GraphError):
    """A store can't be opened."""


class SubLookupNotImplemented(GraphError):
    """A lookup key of three parts."""


class InvalidLookup(GraphError):
    """A lookup that doesn't exist."""


class IndexAlreadyExists(GraphError):
    """An index of the same fields and filters is in the catalog."""


class IndexCreationFailed(GraphError):
    """An index without fields."""


class IncompetentIndex(GraphError):
    """An index was asked for a lookup that it can't serve."""


class IndexRemovalFailed(GraphError):
    """No such index."""


class NoSuchTraversal(GraphError):
    """An edge step from edges."""


class InvalidDataType(GraphError):
    """A field name or value that entities can't hold."""


class MissingKey(GraphError):
    """A store lacks something that it must hold."""


class NotIterable(GraphError):
    """A client asked for the items of something that has none."""


class NotInteger(GraphError):
    """A client gave something else where a whole number is needed."""


class UnknownEntity(GraphError):
    """A handle on a node or edge that isn't there."""


class UnknownScript(GraphError):
    """A script name that no module registers."""


class UnknownAlias(GraphError):
    """An alias that nothing binds."""


class UnknownMethod(GraphError):
    """A random step of an unknown name."""


class MixedKind(GraphError):
    """Nodes and edges in one set operation."""


class InvalidExpression(GraphError):
    """An aggregation expression or sort clause outside the language."""


class UnreachableNode(Exception):  # noqa: N818
    """No path."""
