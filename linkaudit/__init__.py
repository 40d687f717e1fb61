"""Audits of the internal links of websites, as DataFrame-to-DataFrame operators."""
