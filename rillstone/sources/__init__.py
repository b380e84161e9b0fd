"""Where streams come from."""

from .generated import empty, from_range, from_range_closed, generate, infinite, iterate, of, random_values, randomly, repeat
from .text import blob, code_point_file, code_points, lines, records, standard_input, text, text_file

__all__ = ["blob", "code_point_file", "code_points", "empty", "from_range", "from_range_closed", "generate", "infinite", "iterate", "lines", "of", "random_values", "randomly", "records", "repeat", "standard_input", "text", "text_file"]
