"""Explicit schemas of the data model. Nothing in the package infers a schema."""

from __future__ import annotations

SIGNALS = "signal_id int, features array<float>, label bigint, timestamp bigint, sensor_id string"

REGISTRY = "name string, category string, input_shape array<int>, output_desc string, estimated_memory_mb double"

WEIGHTS = "model string, version int, layer string, shape array<int>, data array<float>"

METRICS = "namespace string, metric_name string, value double, unit string, dims map<string,string>, ts timestamp"

_JOB = (
    "struct<jobId:int,name:string,submissionTime:string,completionTime:string,stageIds:array<int>,"
    "status:string,numTasks:int,numCompletedTasks:int,numFailedTasks:int,numCompletedStages:int>"
)
_STAGE = (
    "struct<stageId:int,attemptId:int,status:string,numTasks:int,numActiveTasks:int,numCompleteTasks:int,"
    "numFailedTasks:int,submissionTime:string,completionTime:string,executorDeserializeTime:bigint,"
    "executorRunTime:bigint,executorCpuTime:bigint,resultSize:bigint,jvmGcTime:bigint,"
    "memoryBytesSpilled:bigint,diskBytesSpilled:bigint,inputBytes:bigint,shuffleReadBytes:bigint,"
    "shuffleWriteBytes:bigint,name:string>"
)
_EXECUTOR = (
    "struct<id:string,hostPort:string,isActive:boolean,memoryUsed:bigint,diskUsed:bigint,maxMemory:bigint,"
    "totalCores:int,activeTasks:int,failedTasks:int,completedTasks:int,totalDuration:bigint,"
    "totalGCTime:bigint,totalInputBytes:bigint,totalShuffleRead:bigint>"
)
_STATUS_FIELDS = f"jobs:array<{_JOB}>,stages:array<{_STAGE}>,executors:array<{_EXECUTOR}>"

# One element of a run's task list. Flat fields and the nested executor/timing
# structs are two shapes of the same record; a file fills one or the other.
_TASK = (
    "struct<partition_idx:int,executor_id:string,hostname:string,device:string,cuda_available:boolean,"
    "model_load_time_sec:double,inference_time_sec:double,total_task_time_sec:double,"
    "samples_processed:bigint,per_model_processed:map<string,bigint>,batch_size:int,"
    "executor:struct<id:string,hostname:string,pid:int,device:string,gpu_name:string,gpu_memory_mb:double,cpu_count:int>,"
    "timing:struct<model_load_time_sec:double,total_inference_time_sec:double,total_task_time_sec:double>,"
    "models_run:int,total_samples_processed:bigint,"
    "per_model:map<string,struct<samples_processed:bigint,inference_time_sec:double,throughput:double,"
    "input_shape:array<int>,output_shape:array<int>,batches:int>>>"
)

_MODE_FIELDS = (
    "mode:string,error:string,elapsed_time:double,total_samples_processed:bigint,total_throughput:double,"
    "per_model_processed:map<string,bigint>,num_models:int,num_partitions:int,batch_size:int,num_batches:int,"
    "avg_batch_latency_ms:double,p99_batch_latency_ms:double,num_on_gpu:int,num_on_cpu:int,strategy:string,"
    f"gpu_models:array<string>,cpu_models:array<string>,partition_details:array<{_TASK}>"
)

RUN = (
    "run_id bigint, mode string, device_mode string, elapsed_time double, total_samples_processed bigint, "
    "total_throughput double, per_model_processed map<string,bigint>, num_partitions int, num_models int, "
    "batch_size int, timestamp string, run_number int, status string, error string, "
    f"partition_details array<{_TASK}>, spark_ui_stats struct<app_id:string,{_STATUS_FIELDS}>"
)

MODE_RESULTS = (
    "config struct<signal_samples:int,image_samples:int,detection_samples:int,batch_size:int,partitions:int>, "
    "models map<string,struct<category:string,memory_mb:double>>, "
    f"single_gpu struct<{_MODE_FIELDS}>, hybrid_cpu_gpu struct<{_MODE_FIELDS}>, "
    f"distributed_gpu struct<{_MODE_FIELDS}>, total_benchmark_time double"
)

# A task as the details of a stage list it, by task id.
_STAGE_TASK = (
    "struct<taskId:bigint,index:int,attempt:int,launchTime:string,duration:bigint,executorId:string,host:string,status:string,"
    "taskMetrics:struct<executorRunTime:bigint,executorCpuTime:bigint,jvmGcTime:bigint,resultSize:bigint,peakExecutionMemory:bigint,"
    "memoryBytesSpilled:bigint,diskBytesSpilled:bigint,inputMetrics:struct<bytesRead:bigint,recordsRead:bigint>,"
    "shuffleReadMetrics:struct<localBytesRead:bigint,remoteBytesRead:bigint>,shuffleWriteMetrics:struct<bytesWritten:bigint>>>"
)

STATUS = (
    "application struct<id:string,name:string>, "
    + ", ".join(f"{name} array<{kind}>" for name, kind in (("jobs", _JOB), ("stages", _STAGE), ("executors", _EXECUTOR)))
    + ", environment struct<sparkProperties:array<array<string>>>"
    + f", stage_details array<struct<stageId:int,attemptId:int,status:string,tasks:map<string,{_STAGE_TASK}>>>"
    + ", storage_rdd array<struct<id:int,name:string,numPartitions:int,numCachedPartitions:int,storageLevel:string,memoryUsed:bigint,diskUsed:bigint>>"
)

CLUSTER_STATE = (
    "workers array<struct<state:string,cores:int,coresused:int,memory:bigint,memoryused:bigint>>, "
    "activeapps array<struct<id:string>>, completedapps array<struct<id:string>>"
)

_TASK_METRICS = (
    "`Executor Run Time`:bigint,`Executor CPU Time`:bigint,`JVM GC Time`:bigint,`Result Size`:bigint,"
    "`Memory Bytes Spilled`:bigint,`Disk Bytes Spilled`:bigint,`Peak Execution Memory`:bigint,"
    "`Input Metrics`:struct<`Bytes Read`:bigint>,"
    "`Shuffle Read Metrics`:struct<`Local Bytes Read`:bigint,`Remote Bytes Read`:bigint>,"
    "`Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:bigint>"
)
EVENT_LOG = (
    "Event string, Timestamp bigint, `Stage ID` int, `Executor ID` string, "
    "`Task End Reason` struct<Reason:string>, "
    "`Task Info` struct<`Task ID`:bigint,Index:int,`Executor ID`:string,Host:string,`Launch Time`:bigint,"
    "`Finish Time`:bigint,Failed:boolean>, "
    f"`Task Metrics` struct<{_TASK_METRICS}>, "
    "`Stage Info` struct<`Stage ID`:int,`Stage Attempt ID`:int,`Stage Name`:string,`Number of Tasks`:int,"
    "`Submission Time`:bigint,`Completion Time`:bigint,`Failure Reason`:string>, "
    "`Executor Info` struct<Host:string,`Total Cores`:int>"
)
