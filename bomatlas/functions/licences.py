"""Licence classes."""

from __future__ import annotations

from pyspark.sql import Column

# Fixed value: licences that ask for sharing alike.
COPYLEFT = r"(?i)^(a?gpl|lgpl|mpl|epl|cddl|eupl|osl|cecill)"


def is_copyleft(license_id: Column) -> Column:
    return license_id.rlike(COPYLEFT)
