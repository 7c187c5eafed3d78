"""Where records come from: folders of note files, tables of note texts, rendered tables."""
