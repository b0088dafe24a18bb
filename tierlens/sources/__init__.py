"""Tables: catalog, manifests, storage options, CSV import."""
