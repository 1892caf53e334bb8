"""Exceptions."""

from __future__ import annotations


class LakeError(RuntimeError):
    """A pipeline, codec or bridge can't do what it was asked; the message names the element."""


class RetriableError(LakeError):
    """The same call may succeed later. No error policy swallows it."""


class RegistryError(LakeError):
    """The schema registry answered with an error, or not at all (status 0)."""

    def __init__(self, message: str, status: int = 0):
        super().__init__(message)
        self.status = status


class SchemaPending(RetriableError):
    """A writer schema is being fetched."""

    def __init__(self, schema_id: int):
        super().__init__(f"schema {schema_id} is being fetched")
        self.schema_id = schema_id
