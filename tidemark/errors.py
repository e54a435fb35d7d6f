"""Errors with the code and HTTP status that a service in front of the engine would answer with."""

from __future__ import annotations


class EngineError(Exception):
    code, status = "Internal", 500


class InvalidArgument(EngineError):
    code, status = "InvalidArgument", 400


class SchemaViolation(InvalidArgument):
    def __init__(self, path: str, message: str) -> None:
        super().__init__(f"{path}: {message}")
        self.path, self.message = path, message


class NotFound(EngineError):
    code, status = "NotFound", 404


class UnknownTransaction(NotFound):
    code = "UnknownTxn"


class TransactionConflict(EngineError):
    code, status = "TransactionConflict", 409


class TransactionExpired(EngineError):
    code, status = "TxnExpired", 410


class InvalidState(EngineError):
    code, status = "InvalidState", 500
