"""Ravelin: a Spark-native vector retrieval engine."""

from ravelin.index import VectorIndex
from ravelin.plans.dsl import Instruction, Program, assemble

__version__ = "0.1.0"
__all__ = ["Instruction", "Program", "VectorIndex", "assemble"]
