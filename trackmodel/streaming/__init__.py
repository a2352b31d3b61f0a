"""Streaming: the import run continuously over a folder that providers drop files into."""

from trackmodel.streaming.file_drop import file_drop_import

__all__ = ["file_drop_import"]
