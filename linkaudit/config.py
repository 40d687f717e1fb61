"""Audit settings and the fixed word lists the analyses depend on."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

# --- Fixed values: patterns and word lists that decide results ---------------

#: Origin texts that mark a navigation link (substring test).
NAVIGATION_ORIGINS = ("navigation", "en-tête", "pied de page", "header", "footer", "nav", "menu")

#: Link types that mark a navigation link (equality test).
NAVIGATION_LINK_TYPES = ("navigation", "menu", "footer", "header", "breadcrumb")

#: Anchor patterns used when the configuration names none.
DEFAULT_ANCHOR_PATTERNS = (
    r"^(accueil|home|menu|navigation)$",
    r"^(suivant|précédent|next|previous|page \d+)$",
    r"^(lire la suite|en savoir plus|voir plus|read more|more)$",
    r"^(contact|à propos|mentions légales|cgv|politique|privacy)$",
    r"^\d+$",
    r"^(cliquez ici|cliquer ici|ici|click here|here)$",
    r"^(retour|back|retour accueil)$",
    r"^(passer au contenu|skip to content)$",
    r"^(voir tout|see all|view all)$",
    r"^(\+|\-|\>|\<|\»|\«)$",
    r"^$",
)

#: Anchor patterns of the shipped configuration file; they replace the defaults.
SHIPPED_ANCHOR_PATTERNS = (
    r"^(accueil|home|menu|navigation)$",
    r"^(suivant|précédent|next|previous|page \d+)$",
    r"^(lire la suite|en savoir plus|voir plus|read more)$",
    r"^(contact|à propos|mentions légales|cgv|politique)$",
    r"^\d+$",
    r"^(cliquez ici|cliquer ici|ici|click here)$",
    r"^(retour|back|retour accueil)$",
)

#: Link-path fragments of mechanical page regions ("nav" covers "navigation").
PATH_FRAGMENTS = (
    "header", "footer", "nav", "menu",
    "breadcrumb", "pagination", "pager",
    "sidebar", "widget", "aside",
    "social", "share", "partage",
    "tag", "category", "categorie",
    "related", "connexe", "similaire",
    "role=banner", 'role="banner', "role='banner",
    "role=contentinfo", 'role="contentinfo', "role='contentinfo",
)

DEFAULT_SELECTORS = (".menu", ".nav", ".header", ".footer", ".breadcrumb", ".pagination", ".sidebar")
SHIPPED_SELECTORS = (
    "nav", "header", "footer", ".menu", ".navigation", ".breadcrumb", ".pagination", ".sidebar", ".widget",
)

#: Short anchors that still describe their target.
SHORT_ANCHOR_ALLOWED = ("tv", "pc", "seo", "api", "faq")

#: The reduced rule set (three rules, no configuration).
SIMPLE_ORIGINS = ("navigation", "en-tête", "pied de page")
SIMPLE_ANCHOR_PATTERNS = SHIPPED_ANCHOR_PATTERNS + (r"^(passer au contenu)$", r"^$")
SIMPLE_PATH_FRAGMENTS = ("header", "footer", "nav", "menu", "breadcrumb", "pagination", "sidebar", "widget")

#: Destination categories, tested in this order by substring.
DESTINATION_CATEGORIES = {
    "blog": ("blog", "article", "actualit", "news"),
    "products": ("produit", "product", "service", "solution"),
    "institutional": ("contact", "about", "propos", "equipe", "team"),
    "expertise": ("expertise", "competence", "metier", "domaine"),
    "careers": ("carriere", "emploi", "job", "recrutement"),
}

#: Page types by substring of the URL; what matches none is a section or a specific page.
PAGE_TYPES = {
    "contact": ("contact", "about", "propos"),
    "article": ("blog", "article", "actualit", "news"),
    "product": ("produit", "service", "expertise", "solution"),
}

#: Conversion categories, tested in this order by substring of "url title".
CONVERSION_CATEGORIES = {
    "contact": ("contact", "nous-contacter", "contactez", "get-in-touch"),
    "achat": ("achat", "acheter", "buy", "purchase", "commande", "commander", "order"),
    "inscription": ("inscription", "register", "signup", "sign-up", "s-inscrire"),
    "devis": ("devis", "quote", "estimation", "demande", "request"),
    "panier": ("panier", "cart", "basket", "checkout"),
    "pricing": ("prix", "pricing", "tarifs", "rates", "cost"),
    "demo": ("demo", "demonstration", "essai", "trial", "test"),
}

#: Fragments that disqualify a URL from sampling, by the place the URL list came from.
SKIPPED_URL_PARTS = {
    "deep": ("#", "javascript:", "mailto:", "tel:", "wp-content", "wp-admin", "feed", "tag", "author", "?"),
    "sitemap": ("wp-content", "wp-admin", "feed", "sitemap", "category", "tag"),
    "shallow": ("#", "javascript:", "mailto:", "tel:", "contact", "mentions"),
    "section": ("#", "javascript:", "mailto:"),
}

#: Navigation tags, and fragments of class or id that mark a navigation element.
NAV_TAGS = ("nav", "header", "footer", "aside")
NAV_MARKERS = ("nav", "menu", "header", "footer", "sidebar", "breadcrumb")
NAV_LEVELS = 5

#: Page attributes in priority order; the first six make up the text of a page.
PAGE_ATTRIBUTES = ("titles", "h1", "h2", "h3", "meta_desc", "meta_keywords", "images_alt", "schema_org")
TEXT_ATTRIBUTES = PAGE_ATTRIBUTES[:6]
ALT_TEXT_CHARS = 200

#: File-name stems per page attribute, and header fragments of the value column.
ATTRIBUTE_FILES = {
    "titles": ("page_titles", "titles", "titres"),
    "h1": ("h1", "h1_1"),
    "h2": ("h2", "h2_1"),
    "h3": ("h3", "h3_1"),
    "meta_desc": ("meta_description", "description", "meta_descriptions"),
    "meta_keywords": ("meta_keywords", "keywords", "mots_cles"),
    "images_alt": ("images", "image_alt", "alt_text"),
    "schema_org": ("schema", "structured_data", "schema_org"),
}
ATTRIBUTE_HEADERS = {
    "titles": ("title", "titre", "page title"),
    "h1": ("h1", "heading 1", "titre 1"),
    "h2": ("h2", "heading 2", "titre 2"),
    "h3": ("h3", "heading 3", "titre 3"),
    "meta_desc": ("description", "meta description", "meta_description"),
    "meta_keywords": ("keywords", "meta keywords", "meta_keywords", "mots", "cles"),
    "images_alt": ("alt", "alt text", "alternative", "image alt"),
    "schema_org": ("schema", "structured", "microdata", "json-ld"),
}

#: Export families found by fragments of the file name.
CONTENT_FILES = {
    "word_count": ("word_count", "nombre_mots", "wordcount"),
    "page_titles": ("page_titles", "titles", "titres"),
    "h1": ("h1", "h1_1"),
    "internal": ("internal", "pages_internes", "all_pages"),
}
SEMANTIC_FILES = {
    "embeddings": ("embeddings", "embedding"),
    "similar_pages": ("similar", "cluster", "semantic"),
    "content_clusters": ("content_cluster", "clusters"),
}

#: Words without meaning of their own in an anchor: function words, then web vocabulary.
STOP_WORDS = tuple(
    """
    le de et à un il être en avoir que pour dans ce son une sur avec ne se pas tout plus par grand je qui du elle au
    nous vous ils elles leur leurs cette ces ses nos vos très bien encore toujours déjà aussi puis donc ainsi alors
    après avant depuis pendant comme quand comment pourquoi où dont laquelle lequel lesquels desquels auquel auxquels
    duquel desquelles auxquelles celle celui ceux celles tous toute toutes autre autres même mêmes tel telle tels
    telles quel quelle quels quelles voir savoir faire dire aller venir pouvoir vouloir devoir falloir prendre donner
    mettre porter tenir partir sortir entrer monter descendre passer rester devenir sembler paraître apparaître
    disparaître arriver naître mourir vivre exister ici là ailleurs partout nulle part quelque jamais souvent parfois
    quelquefois rarement peu beaucoup trop assez tant autant si moins davantage plutôt surtout notamment seulement
    uniquement vraiment certainement probablement peut sans doute évidemment naturellement heureusement
    malheureusement découvrir découvrez lire consulter cliquer accéder suivre notre votre

    page site web internet online cliquez suivant précédent retour accueil home menu navigation lien liens article
    articles actualité actualités news blog post
    """.split()
)

#: Words that never name a theme.
THEME_STOP_WORDS = tuple(
    """
    dans avec pour sur sous vers chez sans contre depuis pendant avant après entre parmi selon notre votre leur cette
    ces tous toutes plus moins très bien encore aussi donc
    """.split()
)

# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class AuditConfig:
    """Settings of an audit. The defaults equal the shipped configuration file."""

    anchor_patterns: tuple[str, ...] = SHIPPED_ANCHOR_PATTERNS
    selectors: tuple[str, ...] = SHIPPED_SELECTORS
    max_anchor_repetition: int = 5
    similarity_threshold: float = 0.85
    min_cluster_size: int = 3
    enable_semantic_analysis: bool = True

    min_editorial_ratio: float = 50.0
    min_links_per_page: float = 2.0

    stop_words: tuple[str, ...] = STOP_WORDS
    min_keyword_count: int = 2
    top_keywords: int = 15

    network_nodes: int = 100
    network_edges: int = 500

    @classmethod
    def bare(cls) -> "AuditConfig":
        """The settings that apply without a configuration file."""
        return cls(
            anchor_patterns=DEFAULT_ANCHOR_PATTERNS,
            selectors=DEFAULT_SELECTORS,
            enable_semantic_analysis=False,
        )

    @classmethod
    def from_json(cls, path: str) -> "AuditConfig":
        """Read a JSON configuration; keys that steer no analysis are ignored.

        As an empty pattern or selector list means "use the defaults", so does a missing one.
        """
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        thresholds = raw.get("analysis_thresholds", {})
        semantic = raw.get("semantic_analysis", {})
        base = cls.bare()
        return replace(
            base,
            anchor_patterns=tuple(raw.get("mechanical_anchor_patterns") or base.anchor_patterns),
            selectors=tuple(raw.get("mechanical_selectors") or base.selectors),
            max_anchor_repetition=thresholds.get("max_anchor_repetition", base.max_anchor_repetition),
            similarity_threshold=semantic.get("similarity_threshold", base.similarity_threshold),
            min_cluster_size=semantic.get("min_cluster_size", base.min_cluster_size),
            enable_semantic_analysis=semantic.get("enable_semantic_analysis", base.enable_semantic_analysis),
        )

    def with_options(self, **options) -> "AuditConfig":
        known = {f.name for f in fields(self)}
        unknown = set(options) - known
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **options)
