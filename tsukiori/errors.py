"""Errors that stop a run before anything is published."""


class EtlError(Exception):
    """Base class: the data or the arguments do not allow a run."""


class ContractError(EtlError):
    """The columns of an input are not the agreed ones."""


class EmptyDataError(EtlError):
    """A stage that must hold rows holds none."""


class DuplicateKeyError(EtlError):
    """A lookup has several rows for one key, so a join would multiply rows."""


class NameCollisionError(EtlError):
    """Two source columns translate to one English name."""


class MonthError(EtlError, ValueError):
    """A month argument is not six digits."""


class SourceNotFoundError(EtlError):
    """None of the offered locations can be read."""
