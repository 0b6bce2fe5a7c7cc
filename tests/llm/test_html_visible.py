"""What op6 shows and hides, by the text of small pages."""

import pytest

from casediff.llm.html_layout import render


@pytest.mark.parametrize("tag", [
    'a title="The hidden valley"', 'div class="mt-2 hidden md:flex"', 'div style="overflow: hidden !important"',
    "div data-x='a hidden b'", 'div data-style="display:none"', 'div title="style=\'display:none\'"',
    'div style="--display:none"', 'div style="display:none;display:block"', 'div style="/*display:none*/color:red"',
    'div style="display:block!important;display:none"', "dialog open"])
def test_words_in_attribute_values_hide_nothing(tag):
    assert render(f"<{tag}>text</{tag.split()[0]}> end").split() == ["text", "end"]


@pytest.mark.parametrize("tag", [
    "div hidden", 'div HIDDEN=""', "div class=a hidden=until-found", 'div id="a"hidden', "div hidden/",
    'div style="color:red; DISPLAY : none"', "div style=display:none", 'div style="visibility:hidden !important"',
    'div style="display&#58;none"', "dialog", 'dialog title="now open"'])
def test_attributes_that_hide(tag):
    assert render(f"<{tag}>text</{tag.split()[0]}> end") == "end"


def test_colspan_is_an_attribute():
    assert render('<table><tr><td data-colspan="2">a<td>b<tr><td>ccc<td>d</table>') == "a   | b\nccc | d"


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><p>text", "<head><title>x</title><meta charset=utf-8>text", "<head><link rel=a>&amp;text",
    "<head><body>text", "<head></head>text", "<head><script>a</script><div>text</div>", "<head><svg/>text",
    "<body>text<head>", "<head><html><p>text", "<p>a</p><head><p>text", "<head><style>a</style><h1>text</h1></html>"])
def test_head_ends_without_its_end_tag(page):
    assert render(page).endswith("text")


def test_head_content_stays_hidden():
    assert render("<head>\n <title>no</title> <style>no</style><template>no</template>\n<noscript>no</noscript></head>a") == "a"


@pytest.mark.parametrize("tag", ["svg", "math", "noscript", "object"])
def test_unclosed_elements_drop_nothing(tag):
    assert render(f"<p>one</p><{tag}>two<p>three").split() == ["one", "two", "three"]
    assert render(f"<{tag}>no</{tag}><p>two<{tag}><p>three").split()[-2:] == ["two", "three"]


@pytest.mark.parametrize("tag", ["script", "style", "template"])
def test_unclosed_raw_text_takes_the_rest(tag):
    assert render(f"<p>one</p><{tag}>two<p>three") == "one"


def test_many_unclosed_elements():
    assert render("<object>" * 50000 + "text") == "text"


@pytest.mark.parametrize("page, text", [
    ("Press <button class=x>Save <b>now</b></button> or wait", "Press Save now or wait"),
    ("<button>Yes</button><button>No</button>", "Yes No"),
    ("<p>a <button><div>b</div></button> c", "a\nb\nc"),
    ("Note: <textarea rows=2>\n1 &lt; 2 <b>as is</b></textarea>.", "Note: 1 < 2 <b>as is</b> ."),
    ("<textarea hidden>no</textarea>a<button hidden>no</button>", "a"),
    ("a <textarea>open", "a open"),
    ("<p>Size <select><option>S<option selected>M<option>L</select> please</p>", "Size M please"),
    ("<select><option disabled>pick<optgroup label=x><option>S</option></optgroup></select>", "S"),
    ("<select><option label=Small>S</select>", "Small"),
    ("in <select multiple><option>S<option>M</select> out", "in\nS\nM\nout"),
    ("<select hidden><option>no</select>a", "a"),
    ("<select><option hidden>no<option>b</select>a", "b a"),
    ("a <select><option>b<p>c", "a\nb\n\nc"),
    ("<table><tr><td>x<td><select><option>S<option>M</select><td>y</table>", "x | S | y")])
def test_controls_show_their_text(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page, text", [
    ("Let <math><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow></math> be", "Let x+1 be"),
    ("is <math display=block><mfrac><mn>1</mn><mn>2</mn></mfrac></math>.", "is 1 2."),
    ("<math><semantics><mi>x</mi><annotation>no</annotation></semantics></math>y", "xy"),
    ("<p>a <svg width=9><title>no</title><desc>no</desc><g>no<text>b <tspan>c</tspan></text><text>d</text></g></svg> e",
     "a b c d e"),
    ("<svg><defs><text>no</text></defs><path d=''/><foreignObject><p>a</p></foreignObject></svg>b", "a\n\nb"),
    ("<svg hidden><text>no</text></svg>a<svg style='display:none'><text>no</text></svg>", "a"),
    ("<svg><text/>no<g><p>a</p><svg></svg>", "a"),
    ("<math><mi>a<mo>b<p>c</math>", "ab\n\nc"),
    ("<p>a<svg display=none><text>no</text><p>b</svg>", "a\n\nb")])
def test_formulas_and_drawings_show_their_text(page, text):
    assert render(page) == text
