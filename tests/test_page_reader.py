import pytest

from pagelake.functions.page_reader import read_page, tidy_lines

URL = "https://example.org/a/b?x=1"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<title>T</title><p>one</p><p>two</p>", "Tonetwo"),
        ("<p>a  b</p>", "a\nb"),
        ("<p>a</p>   <p>b</p>", "a b"),
        ("<p>a</p> \n <p>b</p>", "a\nb"),
        ("<pre>a</pre><pre>  </pre><pre>b</pre>", "a\nb"),
        ("x<script>var a = '</p>';</script>y<style>p{}</style>z", "xyz"),
        ("<!DOCTYPE html><!-- no -->a<![CDATA[ b]]>", "a b"),
        ("&amp;&copy;&quot; &#65;&#x42;&#150; &unknown; &lt;b&gt;", '&©" AB– &unknown <b>'),
        ("a&amp<b>b</b>", "a&b"),
        ("<template>no</template><ruby>r<rt>no</rt></ruby>", "r"),
        ("line\x0bone\x85two three", "line\none\ntwo\nthree"),
        ("    a 　", "a"),
        ("", ""),
    ],
)
def test_text(html, text):
    assert read_page(URL, html)["text"] == text


def links(html):
    return [(link["anchor_text"], link["url"]) for link in read_page(URL, html)["links"]]


def test_links_are_absolute_and_first_per_url():
    html = '<a href="/x">x</a><a href="/x">docs</a><a href="c">C</a><a href="#f">F</a><a href="mailto:m@n">M</a>'
    assert links(html) == [
        ("x", "https://example.org/x"),
        ("C", "https://example.org/a/c"),
        ("F", "https://example.org/a/b?x=1#f"),
        ("M", "mailto:m@n"),
    ]


def test_links_need_href_and_anchor():
    assert links('<a>no</a><a href="">no</a><a href="/e"> </a><a href="/i"><img src=x></a>') == []


def test_anchor_strings_are_stripped_and_joined():
    assert links('<a href="/x"> a <b> b </b>\n c</a>') == [("abc", "https://example.org/x")]


def test_unclosed_and_nested_anchors():
    assert links('<div><a href="/x">a<a href="/y">b</a></div>c') == [
        ("ab", "https://example.org/x"),
        ("b", "https://example.org/y"),
    ]


def test_base_is_ignored_and_last_duplicate_attribute_counts():
    assert links('<base href="https://other.org/"><a href="/1" href="/2">a</a>') == [("a", "https://example.org/2")]


def test_title_and_heading():
    page = read_page(URL, "<title> One </title><h1>Two <i>x</i></h1><h1>Three</h1>")
    assert (page["title"], page["heading"]) == ("One", "Two x")


def test_unreadable_pages_give_an_error():
    assert "error" in read_page(URL, '<a href="http://[bad">x</a>')
    assert "error" in read_page(URL, "<![foo[x]]>")


def test_lone_surrogates_are_replaced():
    assert read_page(URL, "a&#xD800;b")["text"] == "a�b"


def test_tidy_lines():
    assert tidy_lines(" a \r\n\n b   c ") == "a\nb\nc"
