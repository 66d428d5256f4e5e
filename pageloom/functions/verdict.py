"""Whether a page is the document or a wall: ordered rules as one native expression, so that it filters without a worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_PAGE_CHARS, SOFT_ERROR_MAX_CHARS, ERROR_TEXT_MAX_CHARS = 4000, 1500, 200

# Fixed values: (vendor, pattern of the title, pattern that decides, pattern that decides on a short page, evidence), in order.
VENDORS = [
    ("cloudflare", r"(?i)^just a moment", None, r"(?i)challenges\.cloudflare\.com|cf-chl-|_cf_chl_opt|cf_chl_rc_|window\._cf_chl", "a Cloudflare challenge script"),
    ("amazon", None, r'(?i)action="[^"]*validateCaptcha', None, "the validateCaptcha form"),
    ("datadome", None, None, r"(?i)captcha-delivery\.com/captcha|geo\.captcha-delivery\.com|dd\.captcha", "a DataDome captcha frame"),
    ("perimeterx", None, None, r"(?i)px-captcha|_pxCaptcha|human-challenge", "a PerimeterX / HUMAN challenge element"),
    ("akamai", r"(?i)^access denied", None, r"(?i)errors\.edgesuite\.net", "an Akamai access-denied page"),
    ("vercel", r"(?i)^vercel security checkpoint", None, r"(?i)vercel\.link/security-checkpoint|_vercel/challenge|x-vercel-challenge-token", "a Vercel Security Checkpoint page"),
    ("aws-waf", None, None, r"window\.gokuProps\s*=", "an AWS WAF challenge interstitial"),
    ("f5", r"(?i)^request rejected$", None, r"(?i)the requested url was rejected\.?\s*please consult with your administrator", 'an F5 "Request Rejected" blocking page'),
    ("fastly", r"(?i)^client challenge$", None, r"/_fs-ch-[\w-]+/", "a Fastly client challenge script"),
]
ERROR_TITLE = r"(?i)^(?:(?:\d{3}\s*[-–—|:]\s*)?(?:error(?: page)?|access denied|forbidden|(?:page )?not found|service unavailable|internal server error|bad gateway|something went wrong|oops!?[^\n]{0,60}))$"
ERROR_TEXT = r"(?i)^(?:something went wrong|oops[!,.]|an (?:unexpected )?error (?:has )?occurred|application error: a client-side exception has occurred)"
ADVICE = {403: "A 403 with no challenge vendor on the page is an IP-reputation or WAF block; the site will not serve this network.", 404: "The site says the URL does not exist — check the path.", 429: "The site is rate-limiting this network; wait before retrying."}
_WS = r"[\s\x{a0}\x{feff}\x{2028}\x{2029}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{_WS}|{_WS}$", "")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _WS, " "))


def challenge(title: Column, html: Column, text: Column) -> Column:
    """struct<vendor, evidence>, or null."""
    title, html, n = trimmed(title), F.coalesce(html, F.lit("")), F.length(collapsed(text))
    rules = []
    for vendor, by_title, sure, on_short, evidence in VENDORS:
        verdict = lambda e, v=vendor: F.struct(F.lit(v).alias("vendor"), e.alias("evidence"))
        if by_title:
            rules.append(F.when(title.rlike(by_title), verdict(F.concat(F.lit('title "'), title, F.lit('"')))))
        if sure:
            rules.append(F.when(html.rlike(sure), verdict(F.lit(evidence))))
        if on_short:
            rules.append(F.when((n < SHORT_PAGE_CHARS) & html.rlike(on_short), verdict(F.concat(F.lit(f"{evidence} on a "), n.cast("string"), F.lit("-character page")))))
    return F.coalesce(*rules)


def verdict(url: Column, title: Column, text: Column, html: Column, status: Column, *, waited_ms: int = 0, allow_empty: bool = False, fetcher: str = "the stealth browser", rendered: bool = True, content_returned: bool = True) -> Column:
    """struct<success, status, error, blocked>: challenge, then status, then empty, then error title, then error text."""
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    wall, head, body, at = challenge(title, html, text), trimmed(title), trimmed(text), F.coalesce(url, F.lit(""))
    short, n = F.regexp_replace(body, _WS, " "), F.length(body)
    why = F.lit("Retry later; the server, not the page, failed.")
    for code, advice in ADVICE.items():
        why = F.when(status == code, F.lit(advice)).otherwise(why)
    size = F.length(F.coalesce(html, F.lit(""))).cast("string")
    reached = fetcher[:1].upper() + fetcher[1:]
    empty = (
        said(f"{reached} reached ", at, f" but the document rendered no title and no text after {waited_ms}ms of extra wait (", size, " bytes of HTML). A JavaScript-rendered page needs a longer wait_for; an empty document means the server sent nothing to render.")
        if rendered
        else said(f"{reached} reached ", at, " but the document has no title and no text (", size, " bytes of HTML). The page is rendered by JavaScript or the server sent an empty shell; only a browser renders it.")
    )
    soft = " — a soft block or an application error. " + ("Retry later, or with a longer wait_for if the site paints content after a placeholder." if rendered else "Retry later; if the site paints content after a placeholder, only a browser renders it.")
    broken = " — the page's script failed. Retry later, or with a longer wait_for if the site paints content after a placeholder." if rendered else " — the page is rendered by JavaScript and this is its fallback; only a browser renders it."
    error = (
        F.when(wall.isNotNull(), said(wall["vendor"], " served a challenge page instead of the content (", wall["evidence"], f"); {fetcher} did not pass it."))
        .when(status >= 400, said("HTTP ", status.cast("string"), ": ", at, " answered with an error page", F.when(head != "", said(' titled "', head, '"')).otherwise(F.lit("")), ", not the resource" + ("; the content returned is that page" if content_returned else "") + ". ", why))
        .when((head == "") & (body == ""), F.lit(None) if allow_empty else empty)
        .when((n < SOFT_ERROR_MAX_CHARS) & head.rlike(ERROR_TITLE), said(at, ' rendered an error page titled "', head, '" (', n.cast("string"), " characters of text) instead of the resource", soft))
        .when((F.length(short) < ERROR_TEXT_MAX_CHARS) & short.rlike(ERROR_TEXT), said(at, ' rendered an application error message ("', F.substring(short, 1, 80), '") under the title "', head, '" instead of the resource', broken))
    )
    return F.struct(error.isNull().alias("success"), status.alias("status"), error.alias("error"), wall.alias("blocked"))
