"""Feature processors: learn from rows visible at train time, transform any rows, say what comes out.

What a processor has learned is its state: a few values that are JSON, and for vocabularies
rows of a table.  ``save`` keeps the states of a whole plan and ``load`` brings processors back
that transform alike.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.scalars import number, time_parts
from tributary.functions.text import HashedVectors, WordVectors
from tributary.operators.features import encode_category
from tributary.operators.stats import TableStatistics, artifact_key, statistics

WORDS = "table string, column string, value string, n bigint, idx bigint"
#: Most values of a column of lists that are told apart, the most frequent first; this bounds what is broadcast.
MOST_ELEMENTS = 10_000


class NotFittedError(RuntimeError):
    """A processor that has learned nothing yet."""


class Processor:
    """One column's way to features.  Parameters are JSON; ``options`` of a kind are checked when it is made."""

    name = ""
    semantic_type = ""
    options: Mapping[str, tuple] = {}
    learns = True

    def __init__(self, column: str, **params):
        self.column, self.params = column, params
        if strange := sorted(set(params) - set(self.options)):
            raise ValueError(f"{self.name} of {column}: unknown parameters {strange}; there are {sorted(self.options)}")
        for key, value in params.items():
            if self.options[key] and value not in self.options[key]:
                raise ValueError(f"{self.name} of {column}: {key} is one of {self.options[key]}, not {value!r}")
        self.values: dict[str, object] | None = None if self.learns else {}

    def fit(self, rows: DataFrame) -> Processor:
        """Learn from rows of the one column; ``learn`` takes statistics of a whole table."""
        return self.learn(statistics(rows, {self.column: self.semantic_type}, separator=self.params.get("separator")))

    def learn(self, found: TableStatistics) -> Processor:
        raise NotImplementedError

    def state(self) -> dict[str, object]:
        if self.values is None:
            raise NotFittedError(f"{self.name} of {self.column}: fit comes before transform")
        return self.values

    def words(self) -> DataFrame | None:
        """(value, n, idx): the part of the state that is a table."""
        return None

    def load(self, values: dict[str, object], words: DataFrame | None = None) -> Processor:
        self.values = values
        return self

    def digest(self) -> str:
        """Of all that decides what transform gives."""
        return artifact_key([self.name, self.column, self.params, self.state()])

    @property
    def output(self) -> str:
        raise NotImplementedError

    def output_spec(self) -> dict[str, str]:
        raise NotImplementedError

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the column ``output``."""
        raise NotImplementedError


class Standardize(Processor):
    """(x - center) / scale; numbers that are missing stay null unless ``fill`` puts the center or zero there."""

    name, semantic_type = "standardize", "numerical"
    options = {"center": ("mean", "median", "none"), "scale": ("std", "quartiles", "none"), "fill": ("none", "center", "zero")}

    def learn(self, found: TableStatistics) -> Standardize:
        s = found.numbers[self.column]
        center = {"mean": s["mean"], "median": s["q50"], "none": 0.0}[self.params.get("center", "mean")]
        spread = s["q75"] - s["q25"] if s["n"] else None
        scale = {"std": s["std"], "quartiles": spread, "none": 1.0}[self.params.get("scale", "std")]
        self.values = {"center": center or 0.0, "scale": scale or 1.0}
        return self

    @property
    def output(self) -> str:
        return f"{self.column}_std"

    def output_spec(self) -> dict[str, str]:
        return {self.output: "double"}

    def transform(self, rows: DataFrame) -> DataFrame:
        s, x = self.state(), number(self.column)
        fill = self.params.get("fill", "none")
        if fill != "none":
            x = F.coalesce(x, F.lit(s["center"] if fill == "center" else 0.0))
        return rows.withColumn(self.output, (x - F.lit(s["center"])) / F.lit(s["scale"]))


class Index(Processor):
    """The place of a value in the vocabulary, most frequent first; -1 for null, unknown, and rarer than ``least_count``."""

    name, semantic_type = "index", "categorical"
    options = {"least_count": ()}
    vocabulary: DataFrame | None = None

    def learn(self, found: TableStatistics) -> Index:
        v = found.vocabulary(self.column).select("value", "n", "idx")
        return self.load({}, v.filter(F.col("n") >= self.params.get("least_count", 1)))

    def load(self, values: dict[str, object], words: DataFrame | None = None) -> Index:
        self.vocabulary = words
        h = F.xxhash64("value", "idx")
        row = words.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
        self.values = {"n": row[0], "checksum": row[1]}
        if values and values != self.values:
            raise ValueError(f"{self.column}: not the vocabulary that was kept")
        return self

    def words(self) -> DataFrame | None:
        self.state()
        return self.vocabulary

    @property
    def output(self) -> str:
        return f"{self.column}_idx"

    def output_spec(self) -> dict[str, str]:
        return {self.output: "bigint"}

    def transform(self, rows: DataFrame) -> DataFrame:
        self.state()
        return encode_category(rows, self.column, self.vocabulary)


class IndexList(Index):
    """As ``index``, for each element of a list (or of a text cut at ``separator``); only the ``most`` frequent are known."""

    name, semantic_type = "index_list", "multicategorical"
    options = {"separator": (), "least_count": (), "most": ()}

    def learn(self, found: TableStatistics) -> IndexList:
        v = found.vocabulary(self.column).select("value", "n", "idx")
        return self.load({}, v.filter((F.col("n") >= self.params.get("least_count", 1)) & (F.col("idx") < min(self.params.get("most", MOST_ELEMENTS), MOST_ELEMENTS))))

    def output_spec(self) -> dict[str, str]:
        return {self.output: "array<bigint>"}

    def transform(self, rows: DataFrame) -> DataFrame:
        self.state()
        known = self.vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("value", "idx"))).alias("__known"))
        items = F.split(F.col(self.column), self.params["separator"]) if "separator" in self.params else F.col(self.column)
        place = F.transform(items, lambda x: F.coalesce(F.element_at("__known", x.cast("string")), F.lit(-1).cast("bigint")))
        return rows.join(F.broadcast(known)).withColumn(self.output, F.coalesce(place, F.array().cast("array<bigint>"))).drop("__known")


class TimeParts(Processor):
    """Year, month, day, weekday, hour, minute and second; -1 each where there is no time."""

    name, semantic_type, learns = "time_parts", "timestamp", False

    def learn(self, found: TableStatistics) -> TimeParts:
        return self

    @property
    def output(self) -> str:
        return f"{self.column}_parts"

    def output_spec(self) -> dict[str, str]:
        return {self.output: "array<int>"}

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.output, F.array(*[F.coalesce(c, F.lit(-1)) for _, c in time_parts(self.column)]))


class Embed(Processor):
    """A vector for each text: of the table of word vectors at ``vectors`` (Parquet with word and vector), else of hashed words."""

    name, semantic_type, learns = "embed", "text_embedded", False
    options = {"dim": (), "vectors": ()}

    def __init__(self, column: str, **params):
        super().__init__(column, **params)
        self.dim = int(params.get("dim", 64))

    def learn(self, found: TableStatistics) -> Embed:
        return self

    def embedder(self, spark: SparkSession) -> HashedVectors | WordVectors:
        if "vectors" not in self.params:
            return HashedVectors(self.dim)
        return WordVectors(spark.read.parquet(self.params["vectors"]), dim=self.dim)

    def digest(self) -> str:
        spark = SparkSession.getActiveSession()
        return artifact_key([self.name, self.column, self.embedder(spark).digest()])

    @property
    def output(self) -> str:
        return f"{self.column}_vec"

    def output_spec(self) -> dict[str, str]:
        return {self.output: "array<float>"}

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.embedder(rows.sparkSession).embed(rows, self.column, self.output)


_PROCESSORS: dict[str, Callable[..., Processor]] = {p.name: p for p in (Standardize, Index, IndexList, TimeParts, Embed)}
DEFAULTS = {p.semantic_type: p.name for p in (Standardize, Index, IndexList, TimeParts, Embed)}


def register_processor(name: str, make: Callable[..., Processor]) -> None:
    _PROCESSORS[name] = make


def processor(name: str, column: str, **params) -> Processor:
    if name not in _PROCESSORS:
        raise ValueError(f"unknown processor {name!r}; there are {sorted(_PROCESSORS)}")
    return _PROCESSORS[name](column, **params)


def plan(types: Mapping[str, str], chosen: Mapping[str, tuple[str | None, Mapping[str, object]]] | None = None) -> list[Processor]:
    """A processor for each column: the one chosen (name, parameters), or the default of its type; types without one raise."""
    out = []
    for column, kind in types.items():
        name, params = (chosen or {}).get(column, (None, {}))
        name = name or DEFAULTS.get(kind)
        if name is None:
            raise ValueError(f"{column}: no processor for {kind}")
        made = processor(name, column, **params)
        if made.semantic_type != kind:
            raise ValueError(f"{column}: {name} is for {made.semantic_type}, not {kind}")
        out.append(made)
    return out


def fit_all(rows: DataFrame, processors: Sequence[Processor]) -> list[Processor]:
    """Fit the processors of a table from one plan of statistics; columns cut at different separators are apart."""
    by_separator: dict[object, dict[str, str]] = {}
    for p in processors:
        by_separator.setdefault(p.params.get("separator"), {})[p.column] = p.semantic_type
    for separator, types in by_separator.items():
        learning = {p.column for p in processors if p.learns}
        found = statistics(rows, {c: k for c, k in types.items() if c in learning}, separator=separator)
        for p in processors:
            if p.column in types:
                p.learn(found)
    return list(processors)


def transform_all(rows: DataFrame, key: str, processors: Sequence[Processor]) -> DataFrame:
    """The key and every processor's output."""
    for p in processors:
        rows = p.transform(rows)
    return rows.select(key, *[p.output for p in processors])


def assemble(encoded: DataFrame, key: str, processors: Sequence[Processor]) -> DataFrame:
    """One array for each semantic type, columns in order of name; a table without features gets the constant 1.0."""
    kinds: dict[str, list[Processor]] = {}
    for p in sorted(processors, key=lambda p: p.column):
        kinds.setdefault(p.semantic_type, []).append(p)
    out = [F.col(key)]
    for kind, own in kinds.items():
        parts = [F.col(p.output) for p in own]
        out.append((F.flatten(F.array(*parts)) if kind == "timestamp" else F.array(*parts)).alias(kind))
    return encoded.select(*out, *([] if kinds else [F.array(F.lit(1.0)).alias("const")]))


def save(spark: SparkSession, path: str, processors: Mapping[str, Sequence[Processor]], identity: object) -> None:
    """Keep the states of the processors of each table under the identity of what they were fitted on."""
    from tributary.sources.artifacts import save_frames, save_json

    spec = {t: [{"name": p.name, "column": p.column, "params": p.params, "state": p.state()} for p in ps] for t, ps in processors.items()}
    words = spark.createDataFrame([], WORDS)
    for t, ps in processors.items():
        for p in ps:
            if (own := p.words()) is not None:
                words = words.unionByName(own.select(F.lit(t).alias("table"), F.lit(p.column).alias("column"), "value", "n", "idx"))
    save_frames({"words": words}, path, identity)
    save_json(spark, f"{path}/processors.json", artifact_key(identity), spec)


def load(spark: SparkSession, path: str, identity: object) -> dict[str, list[Processor]]:
    """Processors as they were saved; those of another identity, or whose rows were altered, raise."""
    from tributary.sources.artifacts import ArtifactError, load_frames, load_json

    spec, words = load_json(spark, f"{path}/processors.json", artifact_key(identity)), load_frames(spark, path, identity)["words"]
    if spec is None:
        raise ArtifactError(f"{path}: no processors for this identity")
    out: dict[str, list[Processor]] = {}
    for t, ps in spec.items():
        out[t] = []
        for s in ps:
            p = processor(s["name"], s["column"], **s["params"])
            own = words.filter((F.col("table") == t) & (F.col("column") == s["column"])).select("value", "n", "idx")
            out[t].append(p.load(s["state"], own))
    return out
