"""Importing this module registers every query of the library."""

from . import governed, retrieval  # noqa: F401
