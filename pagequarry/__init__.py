"""pagequarry: structured rows, page summaries and extraction quality from tables of raw web pages."""

__version__ = "0.1.0"
