"""The registry of templates: what there is, which one reads an address, and running one over a DataFrame of bodies.

A run gives the columns of an envelope. What another engine would throw is a row's error: one bad body can't fail a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from pageloom.functions import urls
from pageloom.functions.bind import bind
from pageloom.functions.scalars import iso_instant
from pageloom.operators import pages, records
from pageloom.sources.requests import NPI_FIELDS, list_url


@dataclass(frozen=True)
class Template:
    """A reader of one kind of body. build gives struct<data, error> of (body, url, params), or is a Reader; list readers' data holds items and count."""

    id: str
    name: str
    description: str
    pattern: str | None
    build: Callable[[Column, Column, dict | None], Column]
    mode: str = "entity"
    params: tuple[str, ...] = ()
    warnings: Callable[[Column, Column], Column] | None = None
    crawl_delay_seconds: int | None = None
    requires_api_key: bool = False
    credential_ref: str | None = None
    extra: dict = field(default_factory=dict)


_JOBS = "All published jobs of a company from its board's public interface, in one shape for all boards."
_PATTERNS = dict(urls.TEMPLATES)
_READERS = [
    ("shopify-product", "Shopify Product", "A shop's product from its JSON endpoint: prices as written, variants, stock.", records.shopify_product, {}),
    ("shopify-collection", "Shopify Collection", "All products of a collection's page from its JSON endpoint.", records.shopify_collection, {"mode": "list", "params": ("store", "collection", "limit", "page")}),
    ("amazon-product", "Amazon Product", "A product page: title, price, rating, reviews, pictures.", pages.amazon_product, {}),
    ("github-repo", "GitHub Repository", "A repository's page: exact counts, topics, licence, first paragraph of its readme.", pages.github_repo, {}),
    ("youtube-video", "YouTube Video", "A video's page from its microdata.", pages.youtube_video, {}),
    ("reddit-thread", "Reddit Thread", "A post from a public archive.", records.reddit_thread, {"warnings": records.reddit_warnings}),
    ("hacker-news-front-page", "Hacker News Front Page", "The stories of a front page, 30 at most.", pages.hacker_news, {}),
    ("producthunt-launch", "Product Hunt Launch", "A launch's page from its streamed state and its meta elements.", pages.producthunt, {}),
    ("stackoverflow-question", "Stack Overflow Question", "A question with its best answers from the public interface.", records.stackoverflow_question, {}),
    ("npm-package", "npm Package", "A package's latest release from the registry.", records.npm_package, {}),
    ("greenhouse-jobs", "Greenhouse Job Board", _JOBS, records.greenhouse_jobs, {"mode": "list", "params": ("company", "content")}),
    ("lever-postings", "Lever Postings", _JOBS, records.lever_postings, {"mode": "list", "params": ("company", "skip", "limit"), "crawl_delay_seconds": 1}),
    ("ashby-jobs", "Ashby Job Board", _JOBS, records.ashby_jobs, {"mode": "list", "params": ("company", "descriptions")}),
    ("workable-jobs", "Workable Jobs", _JOBS, records.workable_jobs, {"mode": "list", "params": ("company", "details")}),
    ("recruitee-offers", "Recruitee Offers", _JOBS, records.recruitee_offers, {"mode": "list", "params": ("company",)}),
    ("teamtailor-jobs", "Teamtailor Jobs", _JOBS, records.teamtailor_jobs, {"mode": "list", "params": ("company", "per_page", "offset")}),
    ("nhtsa-vin", "NHTSA VIN Decode", "A vehicle by its number, with all fields as they came under raw.", records.nhtsa_vin, {"params": ("vin", "modelYear")}),
    ("npi-provider", "NPI Provider Registry", "Health care providers of the public registry, addresses by purpose.", records.npi_provider, {"mode": "list", "params": (*NPI_FIELDS, "limit", "skip")}),
]
TEMPLATES = [Template(i, name, about, _PATTERNS[i], build, **more) for i, name, about, build, more in _READERS]

# Readers that are gone, and why.
RETIRED_REASONS = {
    "linkedin-profile": "linkedin.com/robots.txt disallows every path for all agents except LinkedIn's own crawler, and profile pages sit behind an authentication wall, so there is no compliant way to read a profile.",
    "tweet": "x.com/robots.txt disallows every path for generic agents, and the keyless embed endpoints (cdn.syndication.twimg.com, publish.x.com/oembed) are disallowed by their own robots.txt, so a tweet cannot be read without X API credentials.",
}


def retired_template(id_or_url: Column) -> Column:
    """struct<id, reason> of a reader that is gone, by its id or by an address it read; else null."""
    name = urls.retired(id_or_url)
    why = F.coalesce(*[F.when(name == i, F.lit(r)) for i, r in RETIRED_REASONS.items()])
    return F.when(name.isNotNull(), F.struct(name.alias("id"), why.alias("reason")))


def _empty(c: Column, kind: object) -> Column:
    blank = c == "" if isinstance(kind, StringType) else F.size(c) == 0 if isinstance(kind, ArrayType) else F.lit(False)
    return c.isNull() | F.coalesce(blank, F.lit(False))


class Registry:
    """Templates in the order that decides ties."""

    def __init__(self, templates: Iterable[Template] = TEMPLATES) -> None:
        self.templates = {t.id: t for t in templates}

    def get(self, name: str) -> Template | None:
        return self.templates.get(name)

    def list(self, spark: SparkSession) -> DataFrame:
        rows = [(t.id, t.name, t.description, t.pattern, t.mode, list(t.params) or None, t.requires_api_key or None, t.credential_ref, t.crawl_delay_seconds) for t in self.templates.values()]
        return spark.createDataFrame(rows, "id string, name string, description string, target_pattern string, mode string, params array<string>, requires_api_key boolean, credential_ref string, crawl_delay_seconds int")

    def detect(self, url: Column) -> Column:
        return urls.detect(url, [(t.id, t.pattern) for t in self.templates.values() if t.pattern])

    def list_url(self, name: str, params: dict | None = None) -> str:
        return list_url(name, params)

    def _known(self, name: str, mode: str) -> Template:
        t = self.get(name)
        if t is None:
            raise ValueError(f'Unknown template: "{name}". Available: {", ".join(self.templates)}')
        if mode == "entity" != t.mode:
            raise ValueError(f'Template "{name}" returns a list, not a single entity. Use runList() instead.')
        if mode == "list" != t.mode:
            lists = ", ".join(x.id for x in self.templates.values() if x.mode == "list")
            raise ValueError(f'Template "{name}" returns a single entity, not a list. Use run() instead. List connectors: {lists or "none registered"}.')
        return t

    @staticmethod
    def _read(df: DataFrame, t: Template, body: Column, url: Column, params: dict | None) -> DataFrame:
        """df with _data and _error, each computed once a row."""
        if isinstance(t.build, records.Reader):
            return t.build.on(df, body, url, params)
        out = bind(df, _r=t.build(body, url, params))
        return out.withColumn("_error", F.col("_r.error")).withColumn("_data", F.when(F.col("_error").isNull(), F.col("_r.data"))).drop("_r")

    @staticmethod
    def _nothing(t: Template, data: Column, kind: StructType) -> Column:
        """The error of an entity of which every field is empty."""
        said = f'Template "{t.id}" matched the page but extracted no data — every field came back empty. The server likely answered with an interstitial (captcha, consent or bot wall) or the site changed its layout. This is an extraction failure, not a page with nothing on it.'
        nothing = F.lit(t.mode == "entity")
        for f in kind.fields:
            nothing = nothing & _empty(data[f.name], f.dataType)
        return F.when(nothing, F.lit(said))

    def run(self, df: DataFrame, name: str, *, body: str = "body", url: str = "url", fetched_url: str | None = None, as_of: Column | None = None) -> DataFrame:
        """df with template, template_name, fetched_url (where it differs), data, extracted_at, warnings and error. A record of which every field is empty is an error."""
        t = self._known(name, "entity")
        out = self._read(df, t, F.col(body), F.col(url), None)
        error = F.coalesce(F.col("_error"), self._nothing(t, F.col("_data"), out.schema["_data"].dataType))
        fetched = F.col(fetched_url) if fetched_url else F.lit(None).cast("string")
        return self._envelope(out, t, error, F.when(F.col("error").isNull(), F.col("_data")), as_of).withColumns({
            "fetched_url": F.when(fetched != F.col(url), fetched),
            "warnings": F.when(F.col("error").isNull(), t.warnings(F.col("data"), F.col(url))) if t.warnings else F.lit(None).cast("array<string>"),
        })

    def run_list(self, df: DataFrame, name: str, *, body: str = "body", url: str = "url", params: dict | None = None, as_of: Column | None = None) -> DataFrame:
        """df with template, template_name, data (items, count and what the connector adds), extracted_at and error."""
        t = self._known(name, "list")
        return self._envelope(self._read(df, t, F.col(body), F.col(url), params), t, F.col("_error"), F.col("_data"), as_of)

    def run_all(self, df: DataFrame, *, body: str = "body", url: str = "url", fetched_url: str | None = None, params: dict[str, dict] | None = None, as_of: Column | None = None) -> DataFrame:
        """Bodies of any kinds in one pass: df with template, template_name, mode, fetched_url, data (VARIANT), extracted_at, warnings and error.

        Each row's template is the one that its URL chooses; the body is parsed once, by that template, and the record is a VARIANT, since
        records of different templates differ in type. A URL that no template reads keeps its row, with an error; so does one whose reader is gone.
        Nothing is shuffled, and pages of a kind reach that kind's parser only. params: parameters by template.
        """
        mine = {"_template": F.coalesce(self.detect(F.col(url)), F.lit("")), "_gone": retired_template(F.col(url))["reason"]}
        out = df.withColumns(mine)
        chosen = {t.id: F.col("_template") == t.id for t in self.templates.values() if t.pattern}
        json = [i for i in chosen if isinstance(self.templates[i].build, records.Reader) and not self.templates[i].build.xml]
        out = out.withColumn("_v", F.try_parse_json(F.when(F.col("_template").isin(json), F.col(body))))
        made: dict[str, tuple[Column, Column]] = {}
        docs = {}
        for k, (i, here) in enumerate(chosen.items()):
            t = self.templates[i]
            if isinstance(t.build, records.Reader):
                v = F.when(here, F.col(body)) if t.build.xml else F.when(here, F.col("_v"))
                docs[f"_doc{k}"] = t.build.document(v)
            else:
                docs[f"_doc{k}"] = t.build(F.when(here, F.coalesce(F.col(body), F.lit(""))), F.when(here, F.coalesce(F.col(url), F.lit(""))), (params or {}).get(i))
        out = bind(out, **docs)
        for k, i in enumerate(chosen):
            t, doc = self.templates[i], F.col(f"_doc{k}")
            if isinstance(t.build, records.Reader):
                made[i] = t.build.make(doc, F.col(body) if t.build.xml else F.col("_v"), F.col(url), (params or {}).get(i, {}))
            else:
                made[i] = (doc["data"], doc["error"])
        out = out.withColumns({f"_error{k}": F.when(chosen[i], made[i][1]) for k, i in enumerate(made)})
        out = out.withColumns({f"_data{k}": F.when(chosen[i] & F.col(f"_error{k}").isNull(), made[i][0]) for k, i in enumerate(made)})
        unread = F.when(F.col("_template") == "", F.coalesce(F.col("_gone"), F.concat(F.lit("No template reads "), F.coalesce(F.col(url), F.lit("an unknown address")), F.lit("."))))
        nothing = [F.when(chosen[i] & F.col(f"_error{k}").isNull(), self._nothing(self.templates[i], F.col(f"_data{k}"), out.schema[f"_data{k}"].dataType)) for k, i in enumerate(made) if self.templates[i].mode == "entity"]
        out = out.withColumn("_error", F.coalesce(unread, *[F.col(f"_error{k}") for k in range(len(made))], *nothing))
        fits = F.col("_error").isNull()
        warned = [F.when(fits & chosen[i], self.templates[i].warnings(F.col(f"_data{k}"), F.col(url))) for k, i in enumerate(made) if self.templates[i].warnings]
        name = lambda f: F.coalesce(*[F.when(chosen[i], F.lit(f(self.templates[i]))) for i in chosen])
        fetched = F.col(fetched_url) if fetched_url else F.lit(None).cast("string")
        told = bind(
            out, template=F.when(F.col("_template") != "", F.col("_template")), template_name=name(lambda t: t.name), mode=name(lambda t: t.mode), fetched_url=F.when(fetched != F.col(url), fetched),
            data=F.coalesce(*[F.when(fits, F.to_variant_object(F.col(f"_data{k}"))) for k in range(len(made))]), extracted_at=self._at(as_of),
            warnings=F.coalesce(*warned, F.lit(None).cast("array<string>")), error=F.col("_error"),
        )
        return told.drop(*docs, *(f"_{x}{k}" for x in ("error", "data") for k in range(len(made))), "_v", "_error", *mine)

    @staticmethod
    def _at(as_of: Column | None) -> Column:
        """A time as UTC in text, whatever the session's zone."""
        return iso_instant(F.current_timestamp() if as_of is None else as_of)

    @classmethod
    def _envelope(cls, out: DataFrame, t: Template, error: Column, data: Column, as_of: Column | None) -> DataFrame:
        return out.withColumn("error", error).withColumns({"template": F.lit(t.id), "template_name": F.lit(t.name), "data": data, "extracted_at": cls._at(as_of)}).drop("_data", "_error")


def items(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each item of run_list's rows."""
    return df.select(*keep, F.posexplode("data.items").alias("pos", "item")).select(*keep, "pos", "item.*")


def union_jobs(frames: Iterable[DataFrame]) -> DataFrame:
    """Jobs of several boards (rows of items) in the shape they share."""
    shared = ["id", "title", "url", "location", "department", "team", "employment_type", "remote", "published_at", "updated_at", "description", "source"]
    first, *rest = [f.select(*shared) for f in frames]
    for f in rest:
        first = first.unionByName(f)
    return first
