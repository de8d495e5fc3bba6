"""Exceptions raised by the engine."""


class CombForgeError(Exception):
    """Base class of every error raised on purpose."""


class InvalidConfigurationError(CombForgeError, ValueError):
    """A parameter is outside its domain."""


class SchemaError(CombForgeError, ValueError):
    """The input has neither the ordinary nor the positional feature layout."""


class EmptyInputError(SchemaError, InvalidConfigurationError):
    """The input holds no sequence."""


class EnumerationTooLargeError(CombForgeError, RuntimeError):
    """The predicted number of combinations exceeds the configured limit."""


class InsufficientMemoryError(CombForgeError, RuntimeError):
    """The fixed structures alone exceed the memory target."""
