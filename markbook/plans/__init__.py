"""Every registered query; importing the modules fills the registry."""

from . import answers, corpus, questions, scores, storage, sweeps  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
