"""Column expressions and small helpers shared by the operators."""
from .numbers import percent_of, scaled, text_of_number, trunc_int
from .tables import constant_table
from .text import dotted_part, fold, parent_location, quote_name, resource_part, statement_slice
from .times import as_ts, epoch_micros, millis_between, minutes_between, seconds_between

__all__ = [
    "as_ts", "constant_table", "dotted_part", "epoch_micros", "fold", "millis_between",
    "minutes_between", "parent_location", "percent_of", "quote_name", "resource_part",
    "scaled", "seconds_between", "statement_slice", "text_of_number", "trunc_int",
]
