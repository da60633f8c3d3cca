"""Errors that end a query early, before or while it runs."""


class CleaningError(Exception):
    """Base of all of them."""


class RuleDefinitionError(CleaningError):
    """A rule that names an unknown kind, attribute or operator."""


class ConfigError(CleaningError):
    """A configuration that can't be used, such as an unknown window mode."""


class OrderError(CleaningError):
    """Tuples that come earlier in the order than one already seen."""
