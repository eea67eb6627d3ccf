"""Writers: CSV tables, bills of materials, model documents, workbook tables."""
