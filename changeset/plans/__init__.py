"""The query catalogue and its inputs."""

from . import catalogue, more

__all__ = ["catalogue", "more"]
