"""Written tables, as the rest of the library has them."""

from clausewright.staging import clear, shared_folder, staged

__all__ = ["clear", "shared_folder", "staged"]
