from helpers import edge, empty  # noqa: F401
