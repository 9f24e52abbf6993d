"""Reading and writing tables."""

from .tables import TABLES, Tables, read_table, register, write_table

__all__ = ["TABLES", "Tables", "read_table", "register", "write_table"]
