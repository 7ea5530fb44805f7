from .tables import read_table
from .fixtures import Fixtures
from .files import read_raw, read_table_file, write_table, register, run_sql, table_shape, preview

__all__ = [
    "read_table", "Fixtures", "read_raw", "read_table_file", "write_table",
    "register", "run_sql", "table_shape", "preview",
]
