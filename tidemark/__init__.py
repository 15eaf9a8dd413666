"""tidemark: analytics over operational records that change after they load."""

from tidemark.config import Params

__all__ = ["Params"]
