"""Views over tables, whole routes, and the catalogue of registered queries."""
