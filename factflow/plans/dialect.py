"""One text for derived tables in both Spark SQL and the SQL of the checking engine."""

from __future__ import annotations


class Spark:
    """Spark SQL over the Parquet tables of a folder."""

    def __init__(self, sf_dir: str) -> None:
        self.sf_dir = sf_dir

    def t(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def s(self, pattern: str) -> str:
        return "r'" + pattern.replace("'", "''") + "'"

    def rx_all(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.s(pattern)}, '{to}')"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) div {b})"

    def ts(self, x: str) -> str:
        return f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")"


class Check:
    """The checking engine's SQL over registered views."""

    def t(self, name: str) -> str:
        return name

    def s(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def rx_all(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.s(pattern)}, '{to}', 'g')"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) // {b})"

    def ts(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%dT%H:%M:%S+00:00')"
