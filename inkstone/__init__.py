"""inkstone - text analytics and document-store queries as Spark plans."""
