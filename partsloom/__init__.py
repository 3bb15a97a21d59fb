"""Non-negative matrix factorization of tagged matrices on Spark."""

from .model import Matrix, MatrixError

__all__ = ["Matrix", "MatrixError"]
