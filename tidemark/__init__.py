"""Point-in-time market-data analytics as Spark DataFrame operators."""

from tidemark.contracts import ContractViolation, enforce

__all__ = ["ContractViolation", "enforce"]
