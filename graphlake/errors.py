"""Named errors of the engine."""


class GraphError(Exception):
    """Base of all errors below."""


def _kind(name: str) -> type[GraphError]:
    return type(name, (GraphError,), {"__module__": __name__})


NodeNotFound = _kind("NodeNotFound")
DuplicateNode = _kind("DuplicateNode")
InvalidEdge = _kind("InvalidEdge")
UnknownSchema = _kind("UnknownSchema")
MissingRequiredProperty = _kind("MissingRequiredProperty")
UnknownProperty = _kind("UnknownProperty")
TypeMismatch = _kind("TypeMismatch")
PropertyNotFound = _kind("PropertyNotFound")
EmptyColumn = _kind("EmptyColumn")
UnsupportedAggregationType = _kind("UnsupportedAggregationType")
UnsupportedVectorType = _kind("UnsupportedVectorType")
IndexNotFound = _kind("IndexNotFound")
IndexOutOfBounds = _kind("IndexOutOfBounds")
ParseError = _kind("ParseError")
