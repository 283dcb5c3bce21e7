"""What can go wrong, by name."""


class ForestError(Exception):
    """Base of all errors of the engine."""


class InvalidQuery(ForestError): ...
class InvalidInput(ForestError): ...
class InvalidPath(ForestError): ...
class InvalidProof(ForestError): ...
class InvalidBatchOperation(ForestError): ...
class NotSupported(ForestError): ...
class Overflow(ForestError): ...
class PathNotFound(ForestError): ...
class PathKeyNotFound(ForestError): ...
class PathParentLayerNotFound(ForestError): ...
class CorruptedReferencePathKeyNotFound(ForestError): ...
class CyclicReference(ForestError): ...
class ReferenceLimit(ForestError): ...
class WrongElementType(ForestError): ...
class OverrideNotAllowed(ForestError): ...
class DeletingNonEmptyTree(ForestError): ...
class ClearingTreeWithSubtreesNotAllowed(ForestError): ...
class StopHeightTooLarge(ForestError): ...
class TransactionConflict(ForestError): ...
