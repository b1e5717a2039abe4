"""The template language: what public chat templates use, and what the sandbox refuses."""

import pytest
from levelwise.llm import chat

TALK = {"messages": [{"role": "system", "text": "Be kind."}, {"role": "user", "text": " hi "}, {"role": "assistant", "text": "yo"}]}


def render(source, scope=TALK):
    return "".join(t for t, _ in chat.compile_template(source)(scope))


@pytest.mark.parametrize(
    "source, want",
    [
        ("{% for m in messages %}{{ '<|' + m['role'] + '|>\\n' + m['text'] | trim + '\\n' }}{% endfor %}",
         "<|system|>\nBe kind.\n<|user|>\nhi\n<|assistant|>\nyo\n"),
        ("{%- if messages[0]['role'] == 'system' -%}\n  {{- messages[0].role -}}\n{%- endif %}\n{% for m in messages -%}\n"
         "  {% if m['role'] in ['user', 'assistant'] -%} [{{ m['text'] }}] {%- endif -%}\n{% endfor %}",
         "system\n[ hi ][yo]"),
        ("{% for m in messages %}{% if loop.index % 2 == 1 and not loop.last %}{{ m.role }}{% endif %}{% endfor %}"
         "{% if tools is defined %}t{% else %}none{% endif %}{{ 7 - 2 - 1 }}{{ -1 + 3 }}", "usernone42"),
        ("{{ messages[9].x }}{{ messages[-1]['role'] }}{{ 'b' not in 'abc' }}{{ 1 < 2 }}{{ [1, 'it\\'s'][1] }}", "assistantFalseTrueit's"),
    ],
)
def test_templates_in_public_style(source, want):
    assert render(source) == want


def test_blanks_stay_without_dashes():
    assert render("a {{ 'b' }} c\n{# no #}\nd {{- 'e' -}} f") == "a b c\n\nde" + "f"


def test_constants_are_folded():
    assert chat.simplify(chat.parse("{{ ['a', 'b'][1] + '\\n' }}{% if 3 % 2 == 1 %}x{% endif %}")) == [("text", "b\nx")]


@pytest.mark.parametrize(
    "bad",
    ["{{ [1, 2 }}", "{{ a[0 }}", "{{ a is b }}", "{{ 1 not 2 }}", "{{ a['x'].strip() }}", "{{ a() }}", "{{ [1 2] }}", "{{ 'open }}", "{{ a[ }}", "{{ a[0]. }}"],
)
def test_faulty_templates_are_refused(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_fields_are_no_attributes():
    assert render("{{ v['__class__'] }}{{ v.__class__ }}{{ v[0]['upper'] }}{{ v[0].upper }}", {"v": "text"}) == ""
