"""Marks around an article, or in the names of its states, do not hide it."""

import pytest

from citeflow.llm import html_extract

STORY = "<h1>Head</h1><p>" + "story " * 20 + "</p>"
WANT = "Head\n" + ("story " * 20).strip()
NOISE = "<div class='sidebar'><p>side</p></div><div class='site-footer'><p>foot</p></div><div class='cookie-notice'>cookies</div>"

PAGES = [
    f"<body><div class='content-sidebar-wrap'><article>{STORY}</article></div>{NOISE}</body>",
    f"<body><div id='page-with-sidebar'><article>{STORY}</article>{NOISE}</div></body>",
    f"<body><div class='layout header-fixed'><article>{STORY}</article></div>{NOISE}</body>",
    f"<body><div class='sidebar'><main>{STORY}</main></div>{NOISE}</body>",
    f"<body class='has-sidebar'>{STORY}{NOISE}</body>",
    f"<body class='sidebar'>{STORY}{NOISE}</body>",
    f"<body><div class='banner'>{STORY}</div>{NOISE}</body>",
    f"<body><div class='modal'><div class='overlay'>{STORY}</div></div>{NOISE}</body>",
    f"<body><article class='post comments-open'>{STORY}</article>{NOISE}</body>",
    f"<body><article class='post'>{STORY}</article><section id='comments'><article class='comment'><p>{'reply ' * 90}</p></article><article><p>{'other ' * 90}</p></article></section>{NOISE}</body>",
]


@pytest.mark.parametrize("page", PAGES)
def test_marks(page):
    assert html_extract.main_text(page) == WANT


def test_names():
    assert all(map(html_extract.is_mark, ("sidebar", "site-footer", "cookie-notice", "ad-slot", "nav_bar", "comment-list")))
    assert not any(map(html_extract.is_mark, ("has-sidebar", "comments-open", "header-fixed", "content-sidebar-wrap", "post", "", "related-work", "left")))
