"""Labelled pages: markup of common page layouts beside the main text that a reader would copy out.

Real pages name their parts in a few hundred ways that come back on every site. The tables
below state such openings; a page puts some of them around invented words, so that each
opening stands on several pages, beside different others.
"""

from __future__ import annotations

import random

# Openings of elements that hold the main text.
CONTENT = """
<article>
<main>
<div role="main">
<div id="content">
<div class="post-content">
<div class="entry-content">
<div class="article-body">
<section class="story">
<div itemprop="articleBody">
<div class="main-content">
<div class="post">
<div class="article__text">
""".split("\n")[1:-1]

# Openings of elements beside it.
NOISE = """
<nav>
<div class="menu">
<div class="navbar">
<ul class="navigation">
<div class="breadcrumbs">
<div class="pagination">
<div role="navigation">
<header>
<div class="header">
<div id="masthead">
<div role="banner">
<div class="topbar">
<footer>
<div class="footer">
<div id="colophon">
<div role="contentinfo">
<div class="copyright">
<aside>
<div class="sidebar">
<div role="complementary">
<div class="widget">
<div class="related">
<div class="recommended">
<div class="ad">
<div class="ads">
<div class="advert">
<div class="advertisement">
<div class="sponsored">
<div class="promo">
<ins class="adsbygoogle">
<div class="cookie-notice">
<div id="consent">
<div class="gdpr">
<div class="banner">
<div class="alert">
<div role="alert">
<div role="dialog">
<dialog>
<div class="popup">
<div class="modal">
<div class="newsletter">
<div class="subscribe">
<form>
<div role="search">
<div class="search">
<div class="login">
<fieldset>
<div class="share">
<div class="social">
<div id="comments">
<div class="comment">
<ol class="commentlist">
<div id="disqus_thread">
<section class="responses">
<div class="replies">
<div class="reviews">
<div class="discussion">
<button>
<label>
<select>
<menu>
<noscript>
<template>
<div hidden>
""".split("\n")[1:-1]

HEADINGS = ("<header", '<div class="header', '<div id="masthead')

#: Pages that each content opening stands on, and openings beside it on a page.
PAGES_EACH, NOISE_EACH = 12, 10


def _end(opening: str) -> str:
    return f"</{opening[1:].split()[0].rstrip('>')}>"


def labelled_pages(seed: int = 11) -> list[tuple[str, str]]:
    """``(html, text)``: pages and their main text, blocks joined by an empty line. The same for the same seed."""
    draw = random.Random(seed)

    def words(low: int, high: int) -> str:
        syllables = ["ka", "lo", "mi", "ren", "tu", "sha", "vel", "or", "ix", "pon"]
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(draw.randint(low, high)))

    def noise(opening: str) -> str:
        inside = [
            lambda: "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(draw.randint(2, 6))) + "</ul>",
            lambda: f"<p>{words(3, 25)}</p>",
            lambda: f'<h3>{words(1, 4)}</h3><div><a href="#">{words(2, 6)}</a></div>',
            lambda: words(2, 9),
        ]
        return opening + "".join(draw.choice(inside)() for _ in range(draw.randint(1, 3))) + _end(opening)

    def block(text: str) -> str:
        cut = text.split(" ")
        linked = " ".join([*cut[:2], f'<a href="/x">{" ".join(cut[2:4])}</a>', *cut[4:]])
        return draw.choice(
            [f"<p>{text}</p>"] * 5 + [f"<p>{linked}</p>", f"<p><b>{text}</b></p>", f"<ul><li>{text}</li></ul>", f"<blockquote>{text}</blockquote>", f"<div>{text}</div>", f"<h2>{text}</h2>"]
        )

    pages, turn = [], 0
    for opening in [*CONTENT, ""] * PAGES_EACH:
        beside = [noise(NOISE[(turn + i) % len(NOISE)]) for i in range(NOISE_EACH)]
        turn += NOISE_EACH - 1
        draw.shuffle(beside)
        at, inner = draw.randint(1, NOISE_EACH - 3), draw.randint(0, 2)
        texts = [words(2, 8)] + [words(10, 60) for _ in range(draw.randint(2, 7))]
        parts = [f"<h1>{texts[0]}</h1>", *[block(t) for t in texts[1:]]]
        # A heading part inside an article would be the article's own, so those stay outside.
        beside.sort(key=lambda piece: piece.startswith(HEADINGS))
        for piece in beside[:inner]:
            parts.insert(draw.randint(2, len(parts)), piece)
        plain = f"<div>{words(1, 4)}</div>"
        # Some sites put the title before the element that holds the rest.
        ahead = draw.choice([0, 0, 1])
        body = "".join(parts[:ahead]) + opening + "".join(parts[ahead:]) + (_end(opening) if opening else "")
        order = [*beside[inner : inner + at], plain, body, plain, *beside[inner + at :]]
        page = f'<html><head><title>{texts[0]}</title></head><body><div class="page"><div class="container">{"".join(order)}</div></div></body></html>'
        pages.append((page, "\n\n".join(texts)))
    return pages
