"""Spark-native splitting and review of scanned page bundles."""

from pagebundle.config import SplitConfig

__all__ = ["SplitConfig"]
