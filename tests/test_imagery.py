"""Images with the texts that describe them."""

from pagewarrant.operators import imagery as I
from pagewarrant.sources import dom


def _pairs(spark, html, find):
    nodes = dom.explode_dom(spark.createDataFrame([(1, html)], "page_id long, html string"))
    return {(r["url"], r["alt"]) for r in find(nodes).collect()}


def test_metadata_groups(spark):
    m = lambda name, value, key="property": f"<meta {key}='{name}' content='{value}'>"
    html = (
        m("og:image:url", "0") + m("og:image:alt", "zero") + m("OG:image", "a") + m("og:image:secure_url", "b") + m("twitter:image", "t", "name") + m("og:image:alt", "one") + m("og:image:url", "c")
        + m("og:image", " ") + m("og:image:alt", "lost") + m("twitter:image:alt", "two", "name") + m("og:image", "d") + m("og:image:alt", " ") + m("og:image:alt", "x") + m("og:image:alt", "y")
    )
    assert _pairs(spark, html, I.meta_image_texts) == {("0", "zero"), ("a", "one"), ("b", "one"), ("t", "two"), ("d", "x"), ("d", "y")}


def test_pictures(spark):
    html = (
        "<picture><source srcset='s1 1x, s2 2x'><div><source srcset=far></div><img src=i data-src=lazy srcset='j 2x' alt=A></picture><img src=k alt=' '><img src=l alt=B>"
        "<picture><source srcset=outer><picture><source srcset=inner><img src=m alt=C></picture></picture><s><img src=n alt=D></s><picture><source srcset=none></picture>"
    )
    want = {(u, "A") for u in ("i", "lazy", "j", "s1", "s2")} | {("l", "B"), ("m", "C"), ("inner", "C")}
    assert _pairs(spark, html, I.element_image_texts) == want == _pairs(spark, html, I.image_texts)


def test_no_images(spark):
    assert _pairs(spark, "", I.image_texts) == set() == _pairs(spark, "<p>x</p><meta name=og:image>", I.image_texts)
