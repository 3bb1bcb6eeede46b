"""kvern: a PySpark engine over registry records, page texts and change feeds."""
