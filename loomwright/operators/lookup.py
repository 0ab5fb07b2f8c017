"""Reference tables: adding columns, decoding id lists, two-hop look-ups, embedding averages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import calendar
from loomwright.operators.aggregate import _all_known, first_rows, order_key
from loomwright.operators.encode import dictionary, is_list, joined_codes, joined_lists
from loomwright.plans.columns import containing, q, type_of, with_all
from loomwright.plans.joins import salted_join
from loomwright.plans.operator import Operator

# Decoding a list inside its row walks a literal map, which pays off for short tables only.
MAP_ROWS = 500


def add_columns(
    rows: DataFrame, other: DataFrame, keys: Sequence[str], time_column: str | None = None, unit: str = "date"
) -> DataFrame:
    """Columns of ``other`` that ``rows`` lacks, by inner join; the time key is cut to ``unit`` on both sides."""
    keys = list(keys)
    if time_column is not None:
        rows = rows.withColumn(time_column, calendar.truncated(q(time_column), unit))
        other = other.withColumn(time_column, calendar.truncated(q(time_column), unit))
    new = [c for c in other.columns if c not in rows.columns]
    joined = salted_join(rows, other.select(*[q(k) for k in keys], *[q(c) for c in new]), keys, "inner")
    return joined.select(*[q(c) for c in rows.columns], *[q(c) for c in new])


def short_map(table: DataFrame, limit: int = MAP_ROWS) -> dict | None:
    """A two-column table as a dict when it is proven short, None otherwise."""
    rows = table.limit(limit + 1).collect()
    return {r[0]: r[1] for r in rows} if len(rows) <= limit else None


def literal_map(pairs: Mapping) -> Column:
    if not pairs:
        return F.create_map(F.lit(""), F.lit(None).cast("string"))
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


@dataclass(frozen=True)
class DecodeRegions(Operator):
    """Lists of country-coded ids (``DE123``) as lists of names; unknown ids become NULL.

    ``column`` is a name, a list of names or a part of names. The text ``null`` is dropped and elements
    of another shape stay as they are.
    """

    column: str | tuple[str, ...]
    table: DataFrame | None = None
    value_columns: tuple[str, ...] = ("name", "country_code")
    pairs: Mapping[str, str] | None = None

    # Fixed value: what a coded id looks like.
    SHAPE = "^[A-Z][A-Z][0-9]+$"

    def targets(self, df: DataFrame) -> list[str]:
        if not isinstance(self.column, str):
            return list(self.column)
        return [self.column] if self.column in df.columns else containing(df, self.column)

    def lookup(self) -> DataFrame:
        name = F.concat_ws(", ", *[q(c).cast("string") for c in self.value_columns])
        coded = self.table.select(F.concat(q("country_code"), q("id").cast("string")).alias("k"), name.alias("v"))
        return coded.groupBy("k").agg(F.min("v").alias("v")).where(F.col("v") != "")

    @staticmethod
    def code(element: Column) -> Column:
        return F.concat(F.substring(element, 1, 2), F.substr(element, F.lit(3)).try_cast("bigint").cast("string"))

    def named(self, element: Column, value: Column) -> Column:
        return F.when(element.rlike(self.SHAPE), value).otherwise(element)

    def fit(self, df: DataFrame) -> DecodeRegions:
        return self if self.pairs is not None else replace(self, pairs=short_map(self.lookup()))

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.targets(df):
            out = f"{c}_name"
            clean = F.filter(q(c), lambda x: x.isNull() | (x != F.lit("null")))
            if self.pairs is not None:
                table = literal_map(self.pairs)
                df = df.withColumn(
                    out, F.transform(clean, lambda x: self.named(x, F.try_element_at(table, self.code(x))))
                )
            else:
                prepared = df.withColumn("_list", clean)
                df = joined_lists(prepared, "_list", self.lookup(), out, None, self.code, self.named).drop("_list")
        return df


@dataclass(frozen=True)
class DecodeIds(Operator):
    """Lists of numeric ids as lists of distinct names in first-seen order; unknown ids are dropped."""

    column: str
    table: DataFrame | None = None
    value_column: str = "name"
    strip: str | None = None
    order_by: tuple[str, ...] = ()
    pairs: Mapping[str, str] | None = None

    def lookup(self) -> DataFrame:
        name = q(self.value_column).cast("string")
        first = F.min_by(name, order_key(self.order_by)) if self.order_by else F.min(name)
        found = self.table.groupBy(q("id").cast("string").alias("k")).agg(first.alias("v"))
        return found.select("k", F.trim(F.regexp_replace("v", self.strip, "")).alias("v")) if self.strip else found

    @staticmethod
    def code(element: Column) -> Column:
        return element.cast("string").try_cast("bigint").cast("string")

    def fit(self, df: DataFrame) -> DecodeIds:
        return self if self.pairs is not None else replace(self, pairs=short_map(self.lookup()))

    def transform(self, df: DataFrame) -> DataFrame:
        for c in containing(df, self.column):
            out = f"{c}_{self.value_column}"
            if self.pairs is not None:
                table = literal_map(self.pairs)
                df = df.withColumn(out, F.transform(q(c), lambda x: F.try_element_at(table, self.code(x))))
            else:
                df = joined_lists(df, c, self.lookup(), out, None, self.code)
            df = df.withColumn(out, F.array_distinct(F.array_compact(q(out))))
        return df


@dataclass(frozen=True)
class CountriesFromRegions(Operator):
    """Country lists of a profile, from the first region list of the profile by two look-ups.

    Adds ``region_country`` and fills country lists that are missing or empty.
    """

    country_column: str
    region_column: str
    key: str
    order_by: tuple[str, ...]
    regions: DataFrame | None = None
    countries: DataFrame | None = None
    pairs: Mapping[str, str] | None = None

    whole_table = True

    def lookup(self) -> DataFrame:
        region = self.regions.groupBy(q("region").alias("k")).agg(F.min("country_code").alias("code"))
        country = self.countries.groupBy("code").agg(F.min("country").alias("v"))
        return region.join(country, "code").select("k", "v")

    def fit(self, df: DataFrame) -> CountriesFromRegions:
        return self if self.pairs is not None else replace(self, pairs=short_map(self.lookup()))

    def transform(self, df: DataFrame) -> DataFrame:
        firsts = first_rows(df, [self.key], [self.region_column], self.order_by)
        if self.pairs is not None:
            table = literal_map(self.pairs)
            named = firsts.withColumn(
                "region_country", F.transform(q(self.region_column), lambda x: F.try_element_at(table, x))
            )
        else:
            named = joined_lists(firsts, self.region_column, self.lookup(), "region_country")
        profiles = named.select(
            q(self.key), F.array_sort(F.array_distinct(F.array_compact("region_country"))).alias("region_country")
        )
        joined = salted_join(df.where(_all_known([self.key])), profiles, [self.key], "inner")
        found = joined.select(*[q(c) for c in df.columns], "region_country")
        if self.country_column not in df.columns:
            return found.withColumn(self.country_column, F.col("region_country"))
        given = q(self.country_column)
        return with_all(found, {
            self.country_column: F.when(given.isNull() | (F.size(given) == 0), F.col("region_country")).otherwise(given)
        })


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str, out: str | None = None) -> DataFrame:
    """Element-wise mean of an array column per group; rows without a vector do not count."""
    mean = Summarizer.mean(array_to_vector(q(vector).cast("array<double>")))
    rows = df.where(q(vector).isNotNull())
    return rows.groupBy(*keys).agg(vector_to_array(mean).alias(out or vector))


def vectors_of_groups(
    df: DataFrame, columns: Sequence[str], key: str, order_by: Sequence[str], encoder, value: str, vector: str,
) -> DataFrame:
    """key and ``<c>_clip`` per column: the mean vector of the values in the first row of each group.

    The first rows of all columns are picked together, and all their values go to ``encoder`` (distinct values as a table
    ``value`` -> ``value``, ``vector``) at once, as far as they are of one type; what it gives is averaged in one
    aggregation, so neither the rows nor the encoder are repeated per column. Values without a vector are skipped.
    """
    firsts = first_rows(df, [key], columns, order_by)
    listed = {c: q(c) if is_list(df, c) else F.when(q(c).isNotNull(), F.array(q(c))) for c in columns}
    kinds: dict[str, list[str]] = {}
    for c, items in listed.items():
        kinds.setdefault(firsts.select(items.alias("i")).schema["i"].dataType.simpleString(), []).append(c)
    means = None
    for own in kinds.values():
        # one struct per column: its number and its values
        pairs = F.array(*[F.struct(F.lit(columns.index(c)).alias("_column"), listed[c].alias("_items")) for c in own])
        items = firsts.select(q(key), F.explode(pairs).alias("p")).select(
            q(key), F.col("p")["_column"].alias("_column"), F.explode(F.col("p")["_items"]).alias(value)).where(q(value).isNotNull())
        matched = salted_join(items, encoder(items.select(value).distinct()), [value], "inner")
        made = mean_vectors(matched, [key, "_column"], vector)
        means = made if means is None else means.unionByName(made)
    return means.groupBy(key).agg(*[
        F.max(F.when(F.col("_column") == i, F.struct(q(vector).alias("v"))))["v"].alias(f"{c}_clip") for i, c in enumerate(columns)])


@dataclass(frozen=True)
class AverageEmbeddings(Operator):
    """Mean reference embedding of the first list of each group, on every row of the group.

    The reference table has a code column and an array column ``embedding``; codes without an embedding
    are skipped and a group without any match gets NULL.
    """

    columns: tuple[str, ...]
    key: str
    table: DataFrame
    code: str
    order_by: tuple[str, ...]
    embedding: str = "embedding"

    whole_table = True

    def transform(self, df: DataFrame) -> DataFrame:
        reference = self.table.select(q(self.code).alias("_code"), q(self.embedding).alias("_vector"))
        means = vectors_of_groups(df, self.columns, self.key, self.order_by, lambda values: reference, "_code", "_vector")
        out = salted_join(df.where(_all_known([self.key])), means, [self.key], "left")
        return out.select(*[q(c) for c in df.columns], *[q(f"{c}_clip") for c in self.columns])


@dataclass(frozen=True)
class MapValues(Operator):
    """Replace values, or list elements, through a map.

    A map is a dict or a table (k, v) of any size; long dicts become tables, which are joined. Values that the map lacks
    become NULL, or raise on use when ``strict``. Without a map, codes from 0 are given by sorted value.
    """

    columns: tuple[str, ...]
    maps: Mapping[str, Mapping | DataFrame] | None = None
    strict: bool = False

    def fit(self, df: DataFrame) -> MapValues:
        known = dict(self.maps or {})
        for c in self.columns:
            if c not in known:
                table = dictionary(df, c).select(F.col("value").alias("k"), F.col("index").cast("int").alias("v"))
                short = short_map(table)
                known[c] = table if short is None else short
        return replace(self, maps=known)

    def unmapped(self, column: str, key: Column, value: Column, kind: T.DataType) -> Column:
        if not self.strict:
            return value
        error = F.raise_error(F.concat(F.lit(f"no mapping in {column} for "), key.cast("string")))
        return F.when(key.isNotNull() & value.isNull(), error.cast("string").cast(kind)).otherwise(value)

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            table = self.maps[c]
            if isinstance(table, Mapping) and len(table) > MAP_ROWS:
                table = df.sparkSession.createDataFrame([*table.items()], ["k", "v"])
            listed = is_list(df, c)
            if isinstance(table, DataFrame):
                kind = type_of(df, c).elementType if listed else type_of(df, c)
                table = table.select(F.col("k").cast(kind).alias("k"), "v")
                names = df.columns
                if listed:
                    df = joined_lists(df, c, table, "_mapped")
                else:
                    df = joined_codes(df, c, table, "_mapped")
                    df = df.withColumn("_mapped", self.unmapped(c, q(c), F.col("_mapped"), type_of(df, "_mapped")))
                df = df.select(*[F.col("_mapped").alias(n) if n == c else q(n) for n in names])
                continue
            pairs = literal_map(table)
            if listed:
                value = replace_elements(q(c), pairs)
            else:
                value = F.try_element_at(pairs, q(c))
                value = self.unmapped(c, q(c), value, type_of(df.select(value.alias("v")), "v"))
            df = with_all(df, {c: value})
        return df


def replace_elements(items: Column, table: Column) -> Column:
    return F.transform(items, lambda x: F.try_element_at(table, x))
