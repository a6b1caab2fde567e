"""Errors of the document store."""


class StoreError(Exception):
    """Base of every error that the store raises on purpose."""


class EntryNotFound(StoreError):
    """No entry has the asked ID, or a first/last/seek found no row."""


class RelationshipNotFound(StoreError):
    """A filter names a relationship key that was not declared."""


class EmptyEntryID(StoreError):
    """A write was given an empty ID."""


class Cancelled(StoreError):
    """The context of a transaction was cancelled or ran out of time."""


class BatchSiblingFailed(StoreError):
    """A call of the same batch raised; this one did not, but went with it."""


class MirrorIsReadOnly(StoreError):
    """A write reached a store that mirrors another one."""


class StoreClosed(StoreError):
    """The store was already closed."""


class InvalidAction(StoreError):
    """A change-log record has an unknown type."""


class InvalidKeyLength(StoreError):
    """An AES key is not 16, 24 or 32 bytes long."""


class Break(Exception):
    """Raised by a callback to end a traversal quietly."""
