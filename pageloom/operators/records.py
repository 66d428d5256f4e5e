"""Records from JSON bodies: shops, posts, questions, packages, job boards, vehicles and providers.

A reader parses a body once into a VARIANT, takes the declared fields out of it as one struct, and builds the record of native expressions
over that struct; only markup in descriptions goes through one Arrow function. `Reader.on` binds the document, so that a body is parsed once
however often its fields are named. Called as a function, a reader is one column, struct<data, error>, for a single body. What a source doesn't say is null. A body that
isn't what it should be gives an error text instead of a failed job. Identifiers are texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.bind import bind
from pageloom.functions.scalars import (
    compare_at_price, epoch_iso, filled, fixed2, is_remote, iso_date, join_location, leading_number, money, none, npi_name, npi_part, npi_yes_no, query_int, strip, tags, texts, trimmed, variant_available, vin_error_codes, vin_value,
)
from pageloom.functions.urls import npm_repository_url, safe_href
from pageloom.operators.markup import html_text, html_texts

#: Data and error of a record; data is null where there is an error.
Made = tuple[Column, Column]


def _result(data: Column, *errors: tuple[Column, Column | str]) -> Made:
    """The first condition that holds gives the error, else there is data."""
    return data, F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(say) if isinstance(say, str) else say) for bad, say in errors])


@dataclass(frozen=True)
class Reader:
    """A reader of JSON bodies (or of XML): the type of its document and what makes a record of (document, VARIANT, URL, params)."""

    kind: str
    make: Callable[[Column, Column, Column, dict], Made]
    xml: bool = False

    def parse(self, body: Column) -> Column:
        """The body as VARIANT, null if it is no JSON; XML stays a text."""
        return body if self.xml else F.try_parse_json(body)

    def document(self, v: Column) -> Column:
        return F.from_xml(v, self.kind) if self.xml else F.try_variant_get(v, "$", self.kind)

    def on(self, df: DataFrame, body: Column, url: Column, params: dict | None = None) -> DataFrame:
        """df with _data and _error; the body is parsed once."""
        df = bind(df.withColumn("_v", self.parse(body)), _doc=self.document(F.col("_v")))
        data, error = self.make(F.col("_doc"), F.col("_v"), url, params or {})
        return df.withColumn("_error", error).withColumn("_data", F.when(F.col("_error").isNull(), data)).drop("_v", "_doc")

    def __call__(self, body: Column, url: Column, params: dict | None = None) -> Column:
        v = self.parse(body)
        data, error = self.make(self.document(v), v, url, params or {})
        return F.struct(F.when(error.isNull(), data).alias("data"), error.alias("error"))


def _reader(kind: str, *, xml: bool = False) -> Callable[[Callable[[Column, Column, Column, dict], Made]], Reader]:
    return lambda make: Reader(kind, make, xml)


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("undefined")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _fields(**named: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in named.items()])


def _list(items: Column, total: Column | None = None, **more: Column) -> Column:
    n = F.size(items).cast("long")
    available = {} if total is None else {"total_available": F.when(total > n, total.cast("long"))}
    return _fields(items=items, count=n, **available, **more)


def _array(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


# --- Shops -----------------------------------------------------------------------------------------------------------------------------

_VARIANT = "struct<id:string,title:string,price:string,compare_at_price:string,sku:string,available:boolean,inventory_management:string,inventory_policy:string,inventory_quantity:double,price_currency:string,option1:string,option2:string,option3:string>"
_PRODUCT = f"struct<id:string,title:string,vendor:string,product_type:string,handle:string,body_html:string,tags:string,published_at:string,updated_at:string,variants:array<{_VARIANT}>,options:array<struct<name:string>>,images:array<struct<src:string>>>"


def _variant(v: Column) -> Column:
    return _fields(
        id=v["id"],
        title=v["title"],
        price=money(v["price"]),
        compare_at_price=compare_at_price(v["compare_at_price"]),
        sku=filled(v["sku"]),
        available=variant_available(v),
        inventory_quantity=v["inventory_quantity"],
        options=F.array_compact(F.array(*[filled(v[f"option{k}"]) for k in (1, 2, 3)])),
    )


def shop_product(p: Column, description: Column, **more: Column) -> Column:
    """The record of one product; its description is text already."""
    variants = F.transform(_array(p["variants"], _VARIANT), _variant)
    first = F.get(variants, F.lit(0))
    prices = F.array_compact(F.transform(variants, lambda v: leading_number(v["price"])))
    able = F.transform(variants, lambda v: v["available"])
    return _fields(
        **{k: filled(p[k]) for k in ("title", "vendor", "product_type", "handle")},
        product_id=p["id"],
        price=first["price"],
        compare_at_price=first["compare_at_price"],
        on_sale=F.coalesce(leading_number(first["compare_at_price"]) > leading_number(first["price"]), F.lit(False)),
        currency=filled(F.get(p["variants"], F.lit(0))["price_currency"]),
        price_min=fixed2(F.array_min(prices)),
        price_max=fixed2(F.array_max(prices)),
        available=F.when(F.exists(able, lambda a: F.coalesce(a, F.lit(False))), F.lit(True)).when(F.forall(able, lambda a: F.coalesce(~a, F.lit(False))), F.lit(False)),
        variants=variants,
        options=F.transform(_array(p["options"], "struct<name:string>"), lambda o: o["name"]),
        description=description,
        tags=tags(p["tags"]),
        images=F.transform(_array(p["images"], "struct<src:string>"), lambda i: i["src"]),
        published_at=filled(p["published_at"]),
        updated_at=filled(p["updated_at"]),
        **more,
    )


_SHOP_ONLY = "This template only works on Shopify storefronts."


@_reader(f"struct<product:{_PRODUCT}>")
def shopify_product(doc: Column, v: Column, url: Column, params: dict) -> Made:
    p = doc["product"]
    return _result(
        shop_product(p, html_text(p["body_html"])),
        (v.isNull(), _say("Not a Shopify product endpoint: ", url, f" did not return JSON. {_SHOP_ONLY}")),
        (p["variants"].isNull(), _say("Not a Shopify product endpoint: ", url, f" returned JSON without a product. {_SHOP_ONLY}")),
    )


@_reader(f"struct<products:array<{_PRODUCT}>>")
def shopify_collection(doc: Column, v: Column, url: Column, params: dict) -> Made:
    """All products of a collection's page; has_more says whether the page was full."""
    products = doc["products"]
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    limit, n = F.coalesce(query_int(url, "limit"), F.lit(30)).cast("long"), F.size(products).cast("long")
    page = query_int(url, "page")

    def one(p: Column, text: Column) -> Column:
        at = F.when((origin != "") & filled(p["handle"]).isNotNull(), F.concat(origin, F.lit("/products/"), p["handle"]))
        return shop_product(p, text, url=at)

    items = F.zip_with(products, html_texts(F.transform(products, lambda p: p["body_html"])), one)
    return _result(
        _fields(collection=filled(F.regexp_extract(url, r"(?i)/collections/([^/?#]+)", 1)), items=items, count=n, page=F.when(page != 0, page).otherwise(F.lit(1)).cast("long"), limit=limit, has_more=n == limit),
        (v.isNull(), _say("Not a Shopify collection endpoint: ", url, f" did not return JSON. {_SHOP_ONLY}")),
        (products.isNull(), _say("Not a Shopify collection endpoint: ", url, f" returned JSON without a products array. {_SHOP_ONLY}")),
    )


# --- Posts, questions, packages --------------------------------------------------------------------------------------------------------

_NOTE = 'Read from the Arctic Shift archive, not reddit.com. Scores and comment counts of content less than ~36h old may read 0/1. For the comment tree call reddit_search with mode:"thread" and this id.'
_POST = "id:string,title:string,subreddit:string,author:string,score:double,upvote_ratio:double,num_comments:double,created_utc:double,selftext:string,is_self:boolean,url:string,permalink:string,link_flair_text:string,over_18:boolean,removed_by_category:string,_meta:struct<removal_type:string>"


@_reader(f"struct<error:string,data:array<struct<{_POST}>>>")
def reddit_thread(doc: Column, v: Column, url: Column, params: dict) -> Made:
    p = F.get(doc["data"], F.lit(0))
    data = _fields(
        **{k: p[k] for k in ("id", "title", "subreddit", "author")},
        score=p["score"].cast("long"),
        upvote_ratio=p["upvote_ratio"],
        num_comments=p["num_comments"].cast("long"),
        posted=epoch_iso(p["created_utc"]),
        body=filled(p["selftext"]),
        link_url=F.when(~F.coalesce(p["is_self"], F.lit(False)), safe_href(p["url"])),
        url=F.when(filled(p["permalink"]).isNotNull(), F.concat(F.lit("https://www.reddit.com"), p["permalink"])),
        flair=p["link_flair_text"],
        over_18=F.coalesce(p["over_18"], F.lit(False)),
        removed=F.coalesce(p["removed_by_category"], p["_meta"]["removal_type"]),
        note=F.lit(_NOTE),
    )
    return _result(
        data,
        (v.isNull(), _say("Not an Arctic Shift document: ", url, " did not return JSON. This template reads the Arctic Shift archive, not reddit.com.")),
        (filled(doc["error"]).isNotNull(), _say("Arctic Shift error: ", doc["error"])),
        (p.isNull(), _say("No Reddit post at ", url, ": the Arctic Shift archive has no record of it.")),
    )


def reddit_warnings(data: Column, url: Column) -> Column:
    named = filled(F.regexp_extract(url, r"(?i)reddit\.com/r/([^/?#]+)/comments/", 1))
    text = F.concat(F.lit("The URL names r/"), named, F.lit(", but post "), data["id"], F.lit(" is in r/"), data["subreddit"], F.lit(". Reddit post ids are unique, so this is the post the id names; data.url is its real address."))
    return F.when(F.lower(named) != F.lower(filled(data["subreddit"])), F.array(text))


_OWNER = "owner:struct<display_name:string,reputation:long>"
_ANSWER = f"struct<answer_id:string,score:long,is_accepted:boolean,creation_date:double,body:string,{_OWNER}>"
_QUESTION = f"struct<question_id:string,title:string,body:string,score:long,view_count:long,tags:array<string>,{_OWNER},creation_date:double,last_activity_date:double,link:string,is_answered:boolean,accepted_answer_id:string,answer_count:long,answers:array<{_ANSWER}>>"


@_reader(f"struct<error_id:long,error_name:string,error_message:string,quota_remaining:long,items:array<{_QUESTION}>>")
def stackoverflow_question(doc: Column, v: Column, url: Column, params: dict) -> Made:
    """A question with its five best answers: the accepted one first, then by score; ties in the order they came."""
    q = F.get(doc["items"], F.lit(0))
    answers = _array(q["answers"], _ANSWER)
    ranked = F.array_sort(F.transform(answers, lambda a, i: F.struct((~F.coalesce(a["is_accepted"], F.lit(False))).alias("rest"), (-F.coalesce(a["score"], F.lit(0))).alias("down"), i.alias("i"), a.alias("a"))))
    best = F.transform(F.slice(ranked, 1, 5), lambda r: r["a"])
    shown = F.arrays_zip(html_texts(F.transform(best, lambda a: a["owner"]["display_name"])).alias("author"), html_texts(F.transform(best, lambda a: a["body"])).alias("body"))

    def answer(a: Column, t: Column) -> Column:
        return _fields(answer_id=a["answer_id"], votes=a["score"], accepted=F.coalesce(a["is_accepted"], F.lit(False)), author=t["author"], posted=epoch_iso(a["creation_date"]), body=filled(F.substring(t["body"], 1, 500)))

    own = html_texts(F.array(q["title"], q["body"], q["owner"]["display_name"]))
    data = _fields(
        question_id=q["question_id"],
        title=F.get(own, F.lit(0)),
        body=F.get(own, F.lit(1)),
        votes=q["score"],
        views=q["view_count"],
        tags=_array(q["tags"], "string"),
        author=F.get(own, F.lit(2)),
        author_reputation=q["owner"]["reputation"],
        asked=epoch_iso(q["creation_date"]),
        last_activity=epoch_iso(q["last_activity_date"]),
        link=filled(q["link"]),
        answered=F.coalesce(q["is_answered"], F.lit(False)),
        accepted_answer_id=q["accepted_answer_id"],
        answer_count=F.coalesce(q["answer_count"], F.size(answers).cast("long")),
        answers=F.zip_with(best, shown, answer),
        quota_remaining=doc["quota_remaining"],
    )
    said = _say("Stack Exchange API error ", doc["error_id"].cast("string"), " (", F.coalesce(filled(doc["error_name"]), F.lit("unknown")), "): ", F.coalesce(filled(doc["error_message"]), F.lit("no message")), ".")
    return _result(
        data,
        (v.isNull(), _say("Not a Stack Exchange API document: ", url, " did not return JSON. This template reads the Stack Exchange API.")),
        (doc["error_id"] != 0, said),
        (q.isNull(), _say("No Stack Overflow question at ", url, ": the API returned no items.")),
    )


def npm_license(c: Column) -> Column:
    """A licence as JSON text: a name, an object with a type, or several of them."""
    name = lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.type")).otherwise(filled(x))
    several = filled(F.array_join(F.array_compact(F.transform(F.from_json(c, "array<string>"), name)), ", "))
    return F.when(c.startswith("["), several).otherwise(filled(name(c)))


def npm_bugs_url(c: Column) -> Column:
    return F.when(c.startswith("{"), F.coalesce(filled(F.get_json_object(c, "$.url")), filled(F.get_json_object(c, "$.email")))).otherwise(filled(c))


_RELEASE = "struct<description:string,license:string,homepage:string,repository:string,bugs:string,keywords:array<string>,dependencies:map<string,string>,deprecated:string>"
_PACKAGE = f"struct<name:string,error:string,description:string,license:string,homepage:string,repository:string,bugs:string,keywords:array<string>,maintainers:array<string>,time:map<string,string>,`dist-tags`:map<string,string>,versions:map<string,{_RELEASE}>>"


@_reader(_PACKAGE)
def npm_package(doc: Column, v: Column, url: Column, params: dict) -> Made:
    """The latest release of a package. deprecated is the notice, null without one."""
    latest = filled(F.try_element_at(doc["dist-tags"], F.lit("latest")))
    r = F.try_element_at(doc["versions"], latest)
    either = lambda k: F.coalesce(filled(r[k]), filled(doc[k]))
    repository = either("repository")
    at = F.when(repository.startswith("{"), F.get_json_object(repository, "$.url")).otherwise(repository)
    deps = F.coalesce(r["dependencies"], F.create_map().cast("map<string,string>"))
    people = F.transform(_array(doc["maintainers"], "string"), lambda m: F.when(m.startswith("{"), filled(F.get_json_object(m, "$.name"))).otherwise(filled(m)))
    data = _fields(
        name=doc["name"],
        version=latest,
        description=either("description"),
        license=npm_license(F.coalesce(r["license"], doc["license"])),
        homepage=safe_href(either("homepage")),
        repository=safe_href(npm_repository_url(at)),
        bugs=npm_bugs_url(either("bugs")),
        keywords=F.coalesce(r["keywords"], doc["keywords"], F.array().cast("array<string>")),
        maintainers=F.array_compact(people),
        dependencies=deps,
        dependency_count=F.size(deps).cast("long"),
        deprecated=F.when(~r["deprecated"].isin("true", "false"), r["deprecated"]),
        published=filled(F.try_element_at(doc["time"], latest)),
        last_modified=filled(F.try_element_at(doc["time"], F.lit("modified"))),
        install_command=F.concat(F.lit("npm install "), doc["name"]),
    )
    return _result(
        data,
        (v.isNull(), _say("Not an npm registry document: ", url, " did not return JSON. This template reads the npm registry API.")),
        (doc["name"].isNull(), _say("No npm package at ", url, ": ", F.coalesce(doc["error"], F.lit("no package document")), ".")),
    )


# --- Job boards ------------------------------------------------------------------------------------------------------------------------


def job(source: str, raw_extra: Column, **said: Column) -> Column:
    """One job in the shape that all boards share; what a board doesn't say is null."""
    kinds = {"remote": "boolean"}
    names = ("id", "title", "url", "location", "department", "team", "employment_type", "remote", "published_at", "updated_at", "description")
    return _fields(**{k: said.get(k, none(kinds.get(k, "string"))) for k in names}, source=F.lit(source), raw_extra=raw_extra)


def _link(c: Column) -> Column:
    return safe_href(trimmed(c))


_GREENHOUSE_JOBS = "struct<error:string,meta:struct<total:long>,jobs:array<struct<id:string,title:string,absolute_url:string,company_name:string,location:struct<name:string>,departments:array<struct<name:string>>,offices:array<struct<name:string>>,first_published:string,updated_at:string,content:string,internal_job_id:string,requisition_id:string>>>"


@_reader(_GREENHOUSE_JOBS)
def greenhouse_jobs(doc: Column, v: Column, url: Column, params: dict) -> Made:
    jobs = doc["jobs"]

    def one(j: Column, text: Column) -> Column:
        offices = F.when(j["offices"].isNotNull(), texts(F.transform(j["offices"], lambda o: o["name"])))
        return job(
            "greenhouse-jobs", _fields(internal_job_id=filled(j["internal_job_id"]), requisition_id=trimmed(j["requisition_id"]), offices=offices),
            id=filled(j["id"]), title=trimmed(j["title"]), url=_link(j["absolute_url"]), location=trimmed(j["location"]["name"]), department=trimmed(F.get(j["departments"], F.lit(0))["name"]),
            published_at=iso_date(j["first_published"]), updated_at=iso_date(j["updated_at"]), description=text,
        )

    items = F.zip_with(jobs, html_texts(F.transform(jobs, lambda j: j["content"]), escaped=True), one)
    return _result(
        _list(items, doc["meta"]["total"], company=trimmed(F.get(jobs, F.lit(0))["company_name"])),
        (v.isNull(), _say("Not a Greenhouse job board response: ", url, " did not return JSON. This connector reads the Greenhouse Job Board API.")),
        (jobs.isNull(), _say("No Greenhouse job board at ", url, ": ", F.coalesce(trimmed(doc["error"]), F.lit("no jobs array")), ". The board token is the path segment in https://job-boards.greenhouse.io/<token>.")),
    )


_POSTING = "struct<id:string,text:string,hostedUrl:string,applyUrl:string,workplaceType:string,createdAt:double,descriptionPlain:string,salaryRange:string,categories:struct<location:string,department:string,team:string,commitment:string,level:string,allLocations:array<string>>>"


@_reader(f"array<{_POSTING}>")
def lever_postings(posts: Column, v: Column, url: Column, params: dict) -> Made:

    def one(p: Column) -> Column:
        c = p["categories"]
        extra = _fields(workplace_type=trimmed(p["workplaceType"]), level=trimmed(c["level"]), all_locations=texts(c["allLocations"]), salary_range=filled(p["salaryRange"]), apply_url=_link(p["applyUrl"]))
        return job(
            "lever-postings", extra, id=filled(p["id"]), title=trimmed(p["text"]), url=_link(p["hostedUrl"]), location=trimmed(c["location"]), department=trimmed(c["department"]), team=trimmed(c["team"]),
            employment_type=trimmed(c["commitment"]), remote=is_remote(p["workplaceType"]), published_at=iso_date(none(), p["createdAt"]), description=trimmed(p["descriptionPlain"]),
        )

    said = F.coalesce(trimmed(F.try_variant_get(v, "$.error", "string")), F.lit("the response was not a list of postings"))
    return _result(
        _list(F.transform(posts, one)),
        (v.isNull(), _say("Not a Lever postings response: ", url, " did not return JSON. This connector reads the Lever Postings API.")),
        (posts.isNull(), _say("No Lever postings at ", url, ": ", said, ". The company is the path segment in https://jobs.lever.co/<company>, and the request needs mode=json.")),
    )


_ASHBY_JOBS = "struct<apiVersion:string,jobs:array<struct<id:string,title:string,jobUrl:string,applyUrl:string,location:string,department:string,team:string,employmentType:string,workplaceType:string,publishedAt:string,descriptionPlain:string,secondaryLocations:array<struct<location:string>>>>>"


@_reader(_ASHBY_JOBS)
def ashby_jobs(doc: Column, v: Column, url: Column, params: dict) -> Made:
    """Descriptions are kept where params["descriptions"] is True. The company is params["company"], else the last segment of the URL's path."""

    def one(j: Column) -> Column:
        extra = _fields(workplace_type=trimmed(j["workplaceType"]), secondary_locations=texts(F.transform(j["secondaryLocations"], lambda x: x["location"])), apply_url=_link(j["applyUrl"]))
        return job(
            "ashby-jobs", extra, id=filled(j["id"]), title=trimmed(j["title"]), url=_link(j["jobUrl"]), location=trimmed(j["location"]), department=trimmed(j["department"]), team=trimmed(j["team"]),
            employment_type=trimmed(j["employmentType"]), remote=is_remote(j["workplaceType"]), published_at=iso_date(j["publishedAt"]), description=trimmed(j["descriptionPlain"]) if params.get("descriptions") is True else none(),
        )

    last = trimmed(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*)?/([^/?#]+)/*(?:[?#]|$)", 1))
    company = F.coalesce(trimmed(F.lit(params.get("company")).cast("string")), last)
    return _result(
        _list(F.transform(doc["jobs"], one), company=company, api_version=trimmed(doc["apiVersion"])),
        (v.isNull(), _say("Not a Ashby job board response: ", url, " did not return JSON. This connector reads the Ashby Public Job Posting API.")),
        (doc["jobs"].isNull(), _say("No Ashby job board at ", url, ": no jobs array. The jobs page name is the path segment in https://jobs.ashbyhq.com/<name>.")),
    )


_WORKABLE_JOBS = "struct<name:string,jobs:array<struct<shortcode:string,code:string,title:string,url:string,application_url:string,city:string,state:string,country:string,department:string,employment_type:string,telecommuting:boolean,published_on:string,description:string,function:string>>>"


@_reader(_WORKABLE_JOBS)
def workable_jobs(doc: Column, v: Column, url: Column, params: dict) -> Made:
    jobs = doc["jobs"]

    def one(j: Column, text: Column) -> Column:
        extra = _fields(shortcode=trimmed(j["shortcode"]), code=trimmed(j["code"]), function=trimmed(j["function"]), apply_url=_link(j["application_url"]))
        return job(
            "workable-jobs", extra, id=filled(j["shortcode"]), title=trimmed(j["title"]), url=_link(j["url"]), location=join_location(j["city"], j["state"], j["country"]), department=trimmed(j["department"]),
            employment_type=trimmed(j["employment_type"]), remote=j["telecommuting"], published_at=iso_date(j["published_on"]), description=text,
        )

    items = F.zip_with(jobs, html_texts(F.transform(jobs, lambda j: j["description"])), one)
    return _result(
        _list(items, company=trimmed(doc["name"])),
        (v.isNull(), _say("Not a Workable account response: ", url, " did not return JSON. This connector reads the public Workable accounts endpoint.")),
        (jobs.isNull(), _say("No Workable account at ", url, ": no jobs array. The account subdomain is the path segment in https://apply.workable.com/<subdomain>.")),
    )


_RECRUITEE_OFFERS = "struct<error:string,offers:array<struct<id:string,title:string,careers_url:string,careers_apply_url:string,company_name:string,location:string,department:string,employment_type_code:string,remote:boolean,hybrid:boolean,on_site:boolean,published_at:string,updated_at:string,description:string,slug:string,salary:string,tags:array<string>>>>"


@_reader(_RECRUITEE_OFFERS)
def recruitee_offers(doc: Column, v: Column, url: Column, params: dict) -> Made:
    offers = doc["offers"]

    def one(o: Column, text: Column) -> Column:
        place = F.when(o["remote"], "remote").when(o["hybrid"], "hybrid").when(o["on_site"], "onsite")
        extra = _fields(workplace_type=place, slug=trimmed(o["slug"]), salary=filled(o["salary"]), tags=texts(o["tags"]), apply_url=_link(o["careers_apply_url"]))
        return job(
            "recruitee-offers", extra, id=filled(o["id"]), title=trimmed(o["title"]), url=_link(o["careers_url"]), location=trimmed(o["location"]), department=trimmed(o["department"]),
            employment_type=trimmed(o["employment_type_code"]), remote=is_remote(place), published_at=iso_date(o["published_at"]), updated_at=iso_date(o["updated_at"]), description=text,
        )

    items = F.zip_with(offers, html_texts(F.transform(offers, lambda o: o["description"])), one)
    return _result(
        _list(items, company=trimmed(F.get(offers, F.lit(0))["company_name"])),
        (v.isNull(), _say("Not a Recruitee offers response: ", url, " did not return JSON. This connector reads the Recruitee Careers Site API.")),
        (offers.isNull(), _say("No Recruitee careers site at ", url, ": ", F.coalesce(trimmed(doc["error"]), F.lit("no offers array")), ". The company is the subdomain in https://<company>.recruitee.com.")),
    )


_ITEM = "struct<guid:string,title:string,link:string,pubDate:string,description:string,remoteStatus:string,`tt:department`:string,`tt:role`:string,`tt:division`:string,`tt:locations`:struct<`tt:location`:array<struct<`tt:name`:string>>>>"


@_reader(f"struct<channel:struct<title:string,item:array<{_ITEM}>>>", xml=True)
def teamtailor_jobs(feed: Column, body: Column, url: Column, params: dict) -> Made:
    """A board's RSS feed. from_xml reads it; names keep their prefix."""
    items = _array(feed["channel"]["item"], _ITEM)

    def one(j: Column, text: Column) -> Column:
        locations = texts(F.transform(j["tt:locations"]["tt:location"], lambda x: x["tt:name"]))
        extra = _fields(workplace_type=trimmed(j["remoteStatus"]), role=trimmed(j["tt:role"]), division=trimmed(j["tt:division"]), locations=locations)
        return job(
            "teamtailor-jobs", extra, id=trimmed(j["guid"]), title=trimmed(j["title"]), url=_link(j["link"]), location=filled(F.array_join(locations, ", ")), department=trimmed(j["tt:department"]),
            remote=is_remote(j["remoteStatus"]), published_at=iso_date(j["pubDate"]), description=text,
        )

    made = F.zip_with(items, html_texts(F.transform(items, lambda j: j["description"])), one)
    return _result(
        _list(made, company=trimmed(feed["channel"]["title"])),
        (~F.coalesce(body, F.lit("")).rlike(r"<rss[\s>/]"), _say("No Teamtailor job feed at ", url, ': the response is not an RSS feed. The feed is the careers site jobs page with ".rss" appended, e.g. https://<company>.teamtailor.com/jobs.rss.')),
    )


# --- Public registries -----------------------------------------------------------------------------------------------------------------

# A vehicle record's fields and the names that the registry gives them.
VIN_FIELDS = [
    ("vin", "VIN"), ("vehicle_descriptor", "VehicleDescriptor"), ("make", "Make"), ("model", "Model"), ("model_year", "ModelYear"), ("trim", "Trim"), ("series", "Series"), ("body_class", "BodyClass"),
    ("vehicle_type", "VehicleType"), ("doors", "Doors"), ("drive_type", "DriveType"), ("gvwr", "GVWR"), ("engine_cylinders", "EngineCylinders"), ("engine_displacement_l", "DisplacementL"), ("engine_hp", "EngineHP"),
    ("engine_configuration", "EngineConfiguration"), ("engine_model", "EngineModel"), ("engine_manufacturer", "EngineManufacturer"), ("fuel_type_primary", "FuelTypePrimary"), ("fuel_type_secondary", "FuelTypeSecondary"),
    ("transmission_style", "TransmissionStyle"), ("transmission_speeds", "TransmissionSpeeds"), ("manufacturer", "Manufacturer"), ("plant_city", "PlantCity"), ("plant_state", "PlantState"), ("plant_country", "PlantCountry"),
]


@_reader("struct<message:string,Results:array<map<string,string>>>")
def nhtsa_vin(doc: Column, v: Column, url: Column, params: dict) -> Made:
    first = F.get(doc["Results"], F.lit(0))
    raw = F.transform_values(first, lambda k, v: vin_value(v))
    at = lambda k: F.try_element_at(raw, F.lit(k))
    errors = _fields(codes=vin_error_codes(at("ErrorCode")), text=at("ErrorText"), additional_text=at("AdditionalErrorText"), suggested_vin=at("SuggestedVIN"))
    return _result(
        _fields(**{k: at(name) for k, name in VIN_FIELDS}, decode_errors=errors, raw=raw),
        (v.isNull(), _say("Not a vPIC decode response: ", url, " did not return JSON. This template reads the NHTSA vPIC DecodeVinValues API.")),
        (~F.coalesce(F.map_contains_key(first, "ErrorCode"), F.lit(False)), _say("Not a vPIC decode response: ", url, " returned ", F.coalesce(doc["message"], F.lit("JSON without a decoded vehicle")), ". This template reads the NHTSA vPIC DecodeVinValues API.")),
    )


_ADDRESS = "struct<address_purpose:string,address_1:string,address_2:string,city:string,state:string,postal_code:string,country_code:string,country_name:string,telephone_number:string,fax_number:string>"
_NAME = "organization_name:string,name_prefix:string,prefix:string,first_name:string,middle_name:string,last_name:string,name_suffix:string,suffix:string"
_PROVIDER = f"struct<number:string,enumeration_type:string,basic:struct<{_NAME},credential:string,sole_proprietor:string,status:string,enumeration_date:string,last_updated:string>,addresses:array<{_ADDRESS}>,taxonomies:array<struct<code:string,desc:string,primary:boolean,license:string,state:string,taxonomy_group:string>>,practiceLocations:array<{_ADDRESS}>,other_names:array<struct<type:string,{_NAME}>>>"


def npi_address(a: Column) -> Column:
    names = {"purpose": "address_purpose", "line1": "address_1", "line2": "address_2", **{k: k for k in ("city", "state", "postal_code", "country_code", "country_name")}, "telephone": "telephone_number", "fax": "fax_number"}
    return F.when(a.isNotNull(), _fields(**{k: filled(a[n]) for k, n in names.items()}))


def _npi_name(n: Column) -> Column:
    return npi_name(n["organization_name"], F.coalesce(n["name_prefix"], n["prefix"]), n["first_name"], n["middle_name"], n["last_name"], F.coalesce(n["name_suffix"], n["suffix"]))


@_reader(f"struct<Errors:array<struct<field:string,description:string>>,results:array<{_PROVIDER}>>")
def npi_provider(doc: Column, v: Column, url: Column, params: dict) -> Made:
    """Providers with their addresses by purpose; no person's sex and no official's name is passed on."""

    def one(r: Column) -> Column:
        b = r["basic"]
        of = lambda purpose: F.get(F.filter(r["addresses"], lambda a: a["address_purpose"] == purpose), F.lit(0))
        kinds = F.transform(F.coalesce(r["taxonomies"], F.array().cast("array<struct<code:string,desc:string,primary:boolean,license:string,state:string,taxonomy_group:string>>")), lambda t: _fields(code=filled(t["code"]), description=filled(t["desc"]), primary=F.coalesce(t["primary"], F.lit(False)), license=filled(t["license"]), state=filled(t["state"]), group=filled(t["taxonomy_group"])))
        return _fields(
            npi=filled(r["number"]), enumeration_type=filled(r["enumeration_type"]), name=_npi_name(b), first_name=npi_part(b["first_name"]), last_name=npi_part(b["last_name"]), organization_name=npi_part(b["organization_name"]),
            credential=npi_part(b["credential"]), sole_proprietor=npi_yes_no(b["sole_proprietor"]), status=filled(b["status"]), enumeration_date=filled(b["enumeration_date"]), last_updated=filled(b["last_updated"]),
            primary_taxonomy=F.get(F.filter(kinds, lambda t: t["primary"]), F.lit(0))["description"], taxonomies=kinds, addresses=_fields(location=npi_address(of("LOCATION")), mailing=npi_address(of("MAILING"))),
            practice_locations=F.transform(_array(r["practiceLocations"], _ADDRESS), npi_address), other_names=F.transform(_array(r["other_names"], f"struct<type:string,{_NAME}>"), lambda o: _fields(type=filled(o["type"]), name=_npi_name(o))),
        )

    items = F.transform(doc["results"], one)
    limit, skip = F.coalesce(query_int(url, "limit"), F.lit(10)).cast("long"), F.coalesce(query_int(url, "skip"), F.lit(0)).cast("long")
    detail = F.array_join(F.transform(doc["Errors"], lambda e: F.concat_ws(": ", filled(e["field"]), filled(e["description"]))), "; ")
    return _result(
        _list(items, limit=limit, skip=skip, more_possible=F.size(items).cast("long") == limit),
        (v.isNull(), _say("Not an NPI registry response: ", url, " did not return JSON. This connector reads the NPPES NPI Registry API.")),
        (F.size(doc["Errors"]) > 0, _say("NPI registry rejected the query for ", url, ": ", detail, ".")),
        (doc["results"].isNull(), _say("Not an NPI registry response: ", url, " returned JSON without a results array. This connector reads the NPPES NPI Registry API.")),
    )
