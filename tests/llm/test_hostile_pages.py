"""Pages with broken or hostile markup, and what is and isn't furniture inside an article."""

import time

import pytest

from docgauge.llm import html_text


def text(page):
    return " ".join(t for role, t in html_text.blocks(page) if role == html_text.TEXT)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p title=it's>Hello there</p><p>It's fine</p></article>", "Hello there It's fine"),
        ("<article><p title = \"a > b\" x='<i>' y=z/>one<br/>two</p></article>", "one two"),
        ("<article><p>1 < 2 and <3, a<b>bold</b></p><p>5 > 4</p></article>", "1 < 2 and <3, abold 5 > 4"),
        ("<article><p>before</p><script>if (a</script >x<style>p{}</STYLE>y</article>", "before xy"),
        ("<article><p>keep</p><!-- c > --><p>this</p><!-->now</article> <!-- open", "keep this now"),
        ("<article><p class=\"x>lost</p><p>rest</p></article>", "lost rest"),
        ("<article><p>one</p><svg><path d='x'/></svg><p>two</p><select><option>n</select>three<svg/>four</article>", "one two threefour"),
        ("<article><p>a</p><template>never closed<p>b</p></article>", "a never closed b"),
        ("<article><p =x y==z>odd</p></ p><p>end</p></article>", "odd end"),
    ],
)
def test_broken_markup_loses_no_text(page, want):
    assert text(page) == want


@pytest.mark.parametrize("unit", ["<script ", "<a ", "<p x='", '<p x="', "<a x='>' ", "<", "<!", "<!--", "</", "<svg>", "<script>", "<div>", "&", "<a b=c ", "<p/", "</p x='>'", "<b>", "<template>x", "</div>", "<div></b></p>"])
def test_a_hostile_megabyte_takes_linear_time(unit):
    begin = time.process_time()
    html_text.blocks("<article>" + unit * (1_000_000 // len(unit)))
    assert time.process_time() - begin < 6


@pytest.mark.parametrize("name", ["comment", "post-comments", "reader-comments", "user-comments", "comment-section", "related-posts", "adBox", "ad-slot-728x90", "commentList", "sponsored", "sidebar", "recent-comments"])
def test_comments_and_adverts_inside_an_article_go(name):
    assert text(f'<article><p>Body text</p><div class="{name}"><p>Reader says more</p></div><p>ends</p></article>') == "Body text ends"


@pytest.mark.parametrize("attribute", ['itemprop="comment"', 'itemtype="https://schema.org/Comment"', "itemtype=http://schema.org/WPAdBlock", 'data-ad-slot="1"', 'aria-label="Advertisement"', "hidden", 'role="complementary"'])
def test_attributes_that_name_furniture(attribute):
    assert text(f"<article><p>Body</p><div {attribute}><p>gone</p></div></article>") == "Body"


@pytest.mark.parametrize("part", ['class="section-header"', 'class="social-history"', 'class="discussion"', 'id="discussion"', 'class="address"', 'class="commentary"', 'class="post-content"', 'class="load"'])
def test_words_that_name_no_furniture_stay(part):
    assert text(f"<article><p>Body</p><section {part}><h2>Discussion</h2><p>The results hold.</p></section></article>") == "Body Discussion The results hold."
    assert text("<article><pre><span class='comment'># code</span> x</pre></article>") == "# code x"


def test_a_discussion_goes_if_it_consists_of_comments():
    one = '<div><a class="author">Bob</a> <time>1 May</time><p>nice</p><a class="reply-link">Reply</a></div>'
    for page in (f'<article><p>Body</p><section class="discussion">{one}{one}</section></article>', f"<article><p>Body</p><div><h3>2 comments</h3>{one}{one}</div></article>", f"<article><p>Body</p><ul><h4>Comments (2)</h4>{one}</ul></article>"):
        assert text(page) == "Body"
    assert text("<article><h1>Comments</h1><p>by <a rel=author>Ann</a> <time>1 May</time></p><p>A piece.</p></article>") == "Comments by Ann 1 May A piece."
