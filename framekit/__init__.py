"""framekit: Spark DataFrame operators for collections of digitised video captures."""

from framekit.session import build_session

__all__ = ["build_session"]
