"""Errors by part, under one base."""


class CalibrantError(Exception):
    """Base of all errors of this library."""


class ConfigError(CalibrantError):
    """A configuration can't be read, has unknown keys or bad values."""


class DataError(CalibrantError):
    """A source can't be read or holds no valid row."""


class StateError(CalibrantError):
    """Saved state can't be read or doesn't fit."""
