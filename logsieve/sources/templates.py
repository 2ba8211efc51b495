"""Log templates of the generator, per set, in their given order.

Repeats are kept (a set is drawn by list position, so a repeat is extra weight), and
a few entries are two templates run together in one line (their source lists miss a
separator); they are kept as one template.  `{name}` marks a placeholder.
"""

NORMAL_UNLABELLED = [
    'log_channel(cluster) log [DBG] : osdmap {e}: {total} total, {up} up',
    'log_channel(cluster) log [DBG] : pgmap v{version}: {pgs} pgs: {peering} peering, {active_clean} active+clean; {data} KiB data, {used} GiB used, {avail} GiB avail',
    'log_channel(cluster) log [DBG] : scrub starts',
    'log_channel(cluster) log [DBG] : scrub ok',
    'log_channel(cluster) log [INF] : osd {osd_id} is healthy',
    'log_channel(cluster) log [DBG] : heartbeat from OSD {osd_id}',
    'log_channel(cluster) log [DBG] : recovery completed on osd.{osd_id}',
    'log_channel(cluster) log [INF] : mon.{mon_id} quorum formed with mons: {mon_list}',
    'log_channel(mon) log [INF] : MON {mon_id} joined quorum',
    'log_channel(client) log [INF] : client {client_id} executed command {command} successfully',
    'log_channel(network) log [INF] : network connection established: {network_id}',
    'log_channel(network) log [DBG] : heartbeat received from mon.{mon_id}',
    'log_channel(pg) log [INF] : PG {pg_id} active and clean',
    'log_channel(pg) log [DBG] : PG {pg_id} scrub completed',
    'log_channel(cluster) log [DBG] : recovery completed for PG {pg_id}',
    'log_channel(cluster) log [INF] : snapshot {pg_id} created',
    'log_channel(mds) log [DBG] : MDS.{mds_id} is exporting namespace to rank {rank}',
    'log_channel(mds) log [INF] : MDS.{mds_id} session with client.{client_id} established',
    'log_channel(mds) log [DBG] : MDS.{mds_id} updated inode cache size: {inode_count}',
    'log_channel(rgw) log [INF] : RGW op success: {method} /{bucket}/{object_name}',
    "log_channel(rgw) log [DBG] : RGW bucket index updated for bucket '{bucket}'",
    "log_channel(rgw) log [INF] : RGW user '{user}' authenticated successfully",
    "log_channel(rbd) log [INF] : RBD image '{rbd_image}' mapped to /dev/rbd{rbd_id}",
    "log_channel(rbd) log [DBG] : RBD snapshot '{snapshot}' created for image '{rbd_image}'",
    "log_channel(rbd) log [INF] : RBD unmap operation for image '{rbd_image}' completed successfully",
    'log_channel(client) log [OK] : client {client_id} mount verified',
    'log_channel(cluster) log [INF] : RADOS operation completed for pool {pg_id}',
    'log_channel(cluster) log [DBG] : OSD {osd_id} backfill completed',
    'log_channel(cluster) log [DBG] : auto-scaler adjusted PG count for pool {pg_id}',
    'log_channel(cluster) log [INF] : reweight-by-utilization applied',
    'log_channel(mon) log [DBG] : monitor election finished',
    'log_channel(cluster) log [OK] : health check passed',
    'log_channel(mon) log [INF] : MON {mon_id} beacon received',
    'log_channel(mgr) log [INF] : mgr module reload succeeded',
    'log_channel(cluster) log [INF] : client reconnect complete',
    'log_channel(cluster) log [DBG] : MDS startup completed',
    'log_channel(mon) log [INF] : config update committed',
    'log_channel(audit) log [INF] : auth key accepted for client {client_id}',
    'log_channel(pg) log [DBG] : PG {pg_id} is clean',
    'log_channel(cluster) log [OK] : all services responding',
    'log_channel(mon) log [INF] : no pending health issues',
    'log_channel(cluster) log [INF] : disk utilization within thresholds',
    'log_channel(client) log [INF] : object read completed by client {client_id}',
    'log_channel(cluster) log [DBG] : logs rotated for OSD {osd_id}',
]

NORMAL_LABELLED = [
    'log_channel(cluster) log [DBG] : osdmap {e}: {total} total, {up} up',
    'log_channel(cluster) log [DBG] : scrub starts',
    'log_channel(cluster) log [DBG] : scrub ok',
    'log_channel(client) log [INF] : client {client_id} executed command {command} successfully',
    'log_channel(pg) log [INF] : PG {pg_id} active and clean',
    'log_channel(cluster) log [INF] : osd {osd_id} is healthylog_channel(cluster) log [DBG] : osdmap {e}: {total} total, {up} up',
    'log_channel(cluster) log [DBG] : pgmap v{version}: {pgs} pgs: {peering} peering, {active_clean} active+clean; {data} KiB data, {used} GiB used, {avail} GiB avail',
    'log_channel(cluster) log [DBG] : scrub starts',
    'log_channel(cluster) log [DBG] : scrub ok',
    'log_channel(cluster) log [INF] : osd {osd_id} is healthy',
    'log_channel(cluster) log [DBG] : heartbeat from OSD {osd_id}',
    'log_channel(cluster) log [DBG] : recovery completed on osd.{osd_id}',
    'log_channel(cluster) log [INF] : mon.{mon_id} quorum formed with mons: {mon_list}',
    'log_channel(mon) log [INF] : MON {mon_id} joined quorum',
    'log_channel(client) log [INF] : client {client_id} executed command {command} successfully',
    'log_channel(network) log [INF] : network connection established: {network_id}',
    'log_channel(network) log [DBG] : heartbeat received from mon.{mon_id}',
    'log_channel(pg) log [INF] : PG {pg_id} active and clean',
    'log_channel(pg) log [DBG] : PG {pg_id} scrub completed',
    'log_channel(cluster) log [DBG] : recovery completed for PG {pg_id}',
    'log_channel(cluster) log [INF] : snapshot {pg_id} created',
    'log_channel(mds) log [DBG] : MDS.{mds_id} is exporting namespace to rank {rank}',
    'log_channel(mds) log [INF] : MDS.{mds_id} session with client.{client_id} established',
    'log_channel(mds) log [DBG] : MDS.{mds_id} updated inode cache size: {inode_count}',
    'log_channel(rgw) log [INF] : RGW op success: {method} /{bucket}/{object_name}',
    "log_channel(rgw) log [DBG] : RGW bucket index updated for bucket '{bucket}'",
    "log_channel(rgw) log [INF] : RGW user '{user}' authenticated successfully",
    "log_channel(rbd) log [INF] : RBD image '{rbd_image}' mapped to /dev/rbd{rbd_id}",
    "log_channel(rbd) log [DBG] : RBD snapshot '{snapshot}' created for image '{rbd_image}'",
    "log_channel(rbd) log [INF] : RBD unmap operation for image '{rbd_image}' completed successfully",
    'log_channel(client) log [OK] : client {client_id} mount verified',
    'log_channel(cluster) log [INF] : RADOS operation completed for pool {pg_id}',
    'log_channel(cluster) log [DBG] : OSD {osd_id} backfill completed',
    'log_channel(cluster) log [DBG] : auto-scaler adjusted PG count for pool {pg_id}',
    'log_channel(cluster) log [INF] : reweight-by-utilization applied',
    'log_channel(mon) log [DBG] : monitor election finished',
    'log_channel(cluster) log [OK] : health check passed',
    'log_channel(mon) log [INF] : MON {mon_id} beacon received',
    'log_channel(mgr) log [INF] : mgr module reload succeeded',
    'log_channel(cluster) log [INF] : client reconnect complete',
    'log_channel(cluster) log [DBG] : MDS startup completed',
    'log_channel(mon) log [INF] : config update committed',
    'log_channel(audit) log [INF] : auth key accepted for client {client_id}',
    'log_channel(pg) log [DBG] : PG {pg_id} is clean',
    'log_channel(cluster) log [OK] : all services responding',
    'log_channel(mon) log [INF] : no pending health issues',
    'log_channel(cluster) log [INF] : disk utilization within thresholds',
    'log_channel(client) log [INF] : object read completed by client {client_id}',
    'log_channel(cluster) log [DBG] : logs rotated for OSD {osd_id}',
]

ANOMALY_LABELLED = [
    'log_channel(cluster) log [WRN] : OSD {osd_id} is down: {error_message}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} failure: unable to recover data from {pg_id}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} failure: disk full, unable to write data',
    'log_channel(cluster) log [ERR] : MON {mon_id} crashed due to {crash_reason}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} marked as faulty: {error_details}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} failed to recover from {pg_id} after {time_period}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} disk corruption detected, data may be lost',
    'log_channel(cluster) log [ERR] : OSD {osd_id} cannot find disk, going into error statelog_channel(osd) log [WRN] : inconsistent PG {pg_id} detected [error={error}]',
    'log_channel(mon) log [ERR] : monitor {mon_id} failed to respond [status=DOWN]',
    'log_channel(client) log [ERR] : failed to write object [client={client_id}, reason={reason}]',
    'log_channel(cluster) log [CRIT] : cluster full - no space left to create object',
    'log_channel(mon) log [ERR] : election timeout for monitor {mon_id}',
    'log_channel(osd) log [WRN] : degraded PG {pg_id} [objects_missing={count}]',
    'log_channel(client) log [ERR] : client {client_id} disconnected unexpectedly',
    'log_channel(cluster) log [CRIT] : possible data corruption detected in PG {pg_id}',
    'log_channel(mon) log [ERR] : authentication failure for monitor {mon_id}',
    'log_channel(osd) log [WRN] : OSD {osd_id} heartbeat missed',
    'log_channel(client) log [CRIT] : snapshot write failed [client={client_id}]',
    'log_channel(osd) log [ERR] : read error from OSD {osd_id} [pg={pg_id}]',
    'log_channel(mon) log [CRIT] : monitor {mon_id} clock skew detected',
    'log_channel(cluster) log [ERR] : slow request detected [pg={pg_id}]',
    'log_channel(osd) log [CRIT] : full OSD {osd_id} [no_space_left]',
    'log_channel(mon) log [ERR] : missing monmap entry for {mon_id}',
]

NORMAL_TEST = [
    'log_channel(cluster) log [DBG] : osdmap {e}: {total} total, {up} up',
    'log_channel(cluster) log [DBG] : pgmap v{version}: {pgs} pgs: {peering} peering, {active_clean} active+clean; {data} KiB data, {used} GiB used, {avail} GiB avail',
    'log_channel(cluster) log [DBG] : scrub starts',
    'log_channel(cluster) log [DBG] : scrub ok',
    'log_channel(cluster) log [INF] : osd {osd_id} is healthy',
    'log_channel(cluster) log [DBG] : heartbeat from OSD {osd_id}',
    'log_channel(cluster) log [DBG] : recovery completed on osd.{osd_id}',
    'log_channel(cluster) log [INF] : mon.{mon_id} quorum formed with mons: {mon_list}',
    'log_channel(client) log [INF] : client {client_id} executed command {command} successfully',
    'log_channel(network) log [DBG] : heartbeat received from mon.{mon_id}',
    'log_channel(pg) log [INF] : PG {pg_id} active and clean',
    'log_channel(pg) log [DBG] : PG {pg_id} scrub completed',
    'log_channel(cluster) log [DBG] : recovery completed for PG {pg_id}',
    'log_channel(cluster) log [INF] : snapshot {pg_id} created',
    'log_channel(mds) log [DBG] : MDS.{mds_id} is exporting namespace to rank {rank}',
    'log_channel(mds) log [INF] : MDS.{mds_id} session with client.{client_id} established',
    'log_channel(mds) log [DBG] : MDS.{mds_id} updated inode cache size: {inode_count}',
    'log_channel(rgw) log [INF] : RGW op success: {method} /{bucket}/{object_name}',
    "log_channel(rgw) log [DBG] : RGW bucket index updated for bucket '{bucket}'",
    "log_channel(rgw) log [INF] : RGW user '{user}' authenticated successfully",
    "log_channel(rbd) log [INF] : RBD image '{rbd_image}' mapped to /dev/rbd{rbd_id}",
    "log_channel(rbd) log [DBG] : RBD snapshot '{snapshot}' created for image '{rbd_image}'",
    "log_channel(rbd) log [INF] : RBD unmap operation for image '{rbd_image}' completed successfully",
    'log_channel(cluster) log [INF] : RADOS operation completed for pool {pg_id}',
    'log_channel(cluster) log [DBG] : OSD {osd_id} backfill completed',
    'log_channel(cluster) log [DBG] : auto-scaler adjusted PG count for pool {pg_id}',
    'log_channel(cluster) log [INF] : reweight-by-utilization applied',
    'log_channel(mon) log [INF] : MON {mon_id} beacon received',
    'log_channel(mgr) log [INF] : mgr module reload succeeded',
    'log_channel(cluster) log [INF] : client reconnect complete',
    'log_channel(cluster) log [DBG] : MDS startup completed',
    'log_channel(mon) log [INF] : config update committed',
    'log_channel(audit) log [INF] : auth key accepted for client {client_id}',
    'log_channel(pg) log [DBG] : PG {pg_id} is clean',
    'log_channel(mon) log [INF] : no pending health issues',
    'log_channel(client) log [INF] : object read completed by client {client_id}',
]

ANOMALY_TEST = [
    'log_channel(cluster) log [WRN] : OSD {osd_id} is down: {error_message}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} failure: unable to recover data from {pg_id}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} failure: disk full, unable to write data',
    'log_channel(cluster) log [ERR] : MON {mon_id} crashed due to {crash_reason}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} marked as faulty: {error_details}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} failed to recover from {pg_id} after {time_period}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} disk corruption detected, data may be lost',
    'log_channel(cluster) log [ERR] : OSD {osd_id} cannot find disk, going into error state',
    'log_channel(cluster) log [WRN] : OSD {osd_id} is down: {error_message}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} failure: unable to recover data from {pg_id}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} failure: disk full, unable to write data',
    'log_channel(cluster) log [ERR] : MON {mon_id} crashed due to {crash_reason}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} marked as faulty: {error_details}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} failed to recover from {pg_id} after {time_period}',
    'log_channel(cluster) log [ERR] : OSD {osd_id} disk corruption detected, data may be lost',
    'log_channel(cluster) log [ERR] : OSD {osd_id} cannot find disk, going into error statelog_channel(osd) log [WRN] : inconsistent PG {pg_id} detected [error={error}]',
    'log_channel(mon) log [ERR] : monitor {mon_id} failed to respond [status=DOWN]',
    'log_channel(client) log [ERR] : failed to write object [client={client_id}, reason={reason}]',
    'log_channel(cluster) log [CRIT] : cluster full - no space left to create object',
    'log_channel(mon) log [ERR] : election timeout for monitor {mon_id}',
    'log_channel(osd) log [WRN] : degraded PG {pg_id} [objects_missing={count}]',
    'log_channel(client) log [ERR] : client {client_id} disconnected unexpectedly',
    'log_channel(cluster) log [CRIT] : possible data corruption detected in PG {pg_id}',
    'log_channel(mon) log [ERR] : authentication failure for monitor {mon_id}',
    'log_channel(osd) log [WRN] : OSD {osd_id} heartbeat missed',
    'log_channel(client) log [CRIT] : snapshot write failed [client={client_id}]',
    'log_channel(osd) log [ERR] : read error from OSD {osd_id} [pg={pg_id}]',
    'log_channel(mon) log [CRIT] : monitor {mon_id} clock skew detected',
    'log_channel(cluster) log [ERR] : slow request detected [pg={pg_id}]',
    'log_channel(osd) log [CRIT] : full OSD {osd_id} [no_space_left]',
    'log_channel(mon) log [ERR] : missing monmap entry for {mon_id}',
]
