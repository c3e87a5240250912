"""Table work on Spark: diff, sync, transfer, import, export, search,
document-style stages, paging, generation and queue monitoring, each as a
function from DataFrames to DataFrames."""
